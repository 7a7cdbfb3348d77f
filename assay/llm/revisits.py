"""WARC: not-modified revisits are resolved by an as-of join to the latest earlier full response of the same canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm._state import keep

# Headers of a not-modified answer that must not change those of the stored response.
KEPT_HEADERS = (
    "connection content-encoding content-length content-location content-md5 content-range content-type keep-alive "
    "proxy-authenticate proxy-authentication-info proxy-authorization proxy-connection te trailer transfer-encoding upgrade"
).split()
#: Records of one URL are ordered in slots of so many time units, so that a URL that is fetched very often is many tasks'.
SLOT = 100_000
#: Query parameters that don't tell pages apart.
TRACKING = "^(utm_[a-z]+|gclid|fbclid|ref)="


def canonical_url(url: Column) -> Column:
    """Host, path and query of a URL, as one key; null where there is no host.

    The scheme, the fragment, www., default ports, a last slash and tracking parameters go; the host is
    lower-cased, parameters are sorted."""
    host = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), r"/+$", "")
    given = F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def lower_headers(entries: Column) -> Column:
    """Header entries as a map with lower-case names; of several of one name the last; null is none."""
    entries = F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>"))
    names = F.array_sort(F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"]))))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"].alias("value"))))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, brought up to date by those that a not-modified answer may change. Both of lower_headers()."""
    may = F.map_filter(fresh, lambda k, _: ~k.isin(KEPT_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(may), k)), may)


def as_of(records: DataFrame, slot: int = SLOT) -> DataFrame:
    """record_id and response_id (null where there is none) of each revisit.

    records: key, ts, record_id, full. Each slot of a key is ordered by itself; what a slot needs from
    earlier ones is their last full response, one row a slot."""
    rows = records.where("key IS NOT NULL AND ts IS NOT NULL").withColumn("slot", F.floor(F.col("ts") / slot))
    last = rows.where("full").groupBy("key", "slot").agg(F.max(F.struct("ts", "record_id")).alias("last"))
    slots = rows.select("key", "slot").distinct().join(last, ["key", "slot"], "left")
    before = Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select("key", "slot", F.last("last", ignorenulls=True).over(before).alias("carried"))
    # At one time full responses come first, so that a revisit may refer to one of its own second.
    order = Window.partitionBy("key", "slot").orderBy("ts", F.desc("full"), "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = rows.select("key", "slot", "record_id", "full", F.last(F.when(F.col("full"), F.col("record_id")), ignorenulls=True).over(order).alias("own"))
    return inner.where("NOT full").join(carried, ["key", "slot"]).select("record_id", F.coalesce("own", F.col("carried.record_id")).alias("response_id"))


def resolve_revisits(records: DataFrame, slot: int = SLOT) -> DataFrame:
    """One row for each revisit: record_id, key, response_id, outcome, headers, payload.

    records: record_id, url, ts (whole number), full (true for a full response), headers (map), payload; other
    columns are left out, and rows without a record_id; of rows of one record_id the first by url, ts and kind
    counts. A revisit takes the latest full response of its canonical URL that isn't later. Its validators are
    checked: an ETag of both must be equal (a weak mark W/ doesn't count), without one of both
    Last-Modified must be; with neither the outcome is unvalidated, and the payload is taken too.
    Outcomes: resolved, unvalidated, changed (validators differ), missing (no response), invalid (no
    URL or time). Only the first two have headers and a payload. Null full counts as a revisit."""
    full = F.coalesce("full", F.lit(False))
    entries = F.array_sort(F.map_entries("headers"))  # maps have no order, arrays do
    # The payload's hash stands for it, so that it is neither sorted nor shuffled here.
    row = F.struct("url", F.col("ts").cast("long").alias("ts"), full.alias("full"), entries.alias("entries"), F.xxhash64("payload").alias("digest"))
    first = records.where("record_id IS NOT NULL").groupBy("record_id").agg(F.min(row).alias("r"))
    light = keep(first.select("record_id", canonical_url(F.col("r.url")).alias("key"), "r.ts", "r.full", lower_headers(F.col("r.entries")).alias("headers"), "r.digest"), "warc-records")
    found = as_of(light.drop("headers"), slot)
    mine = light.where("NOT full").join(found, "record_id", "left")
    # Payloads are joined by the id found, once, and never sorted.
    bodies = records.where("full").select(F.col("record_id").alias("response_id"), F.xxhash64("payload").alias("digest"), "payload").dropDuplicates(["response_id", "digest"])
    full = light.where("full").select(F.col("record_id").alias("response_id"), F.col("headers").alias("stored"), "digest").join(bodies, ["response_id", "digest"])
    both = mine.join(full, "response_id", "left")
    pick = lambda m, k: F.try_element_at(F.col(m), F.lit(k))
    tag = lambda m: F.regexp_replace(pick(m, "etag"), "^W/", "")
    same = F.coalesce(tag("headers") == tag("stored"), pick("headers", "last-modified") == pick("stored", "last-modified"))
    outcome = F.when(F.col("key").isNull() | F.col("ts").isNull(), "invalid").when(F.col("response_id").isNull(), "missing").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("changed")
    good = F.col("outcome").isin("resolved", "unvalidated")
    return both.withColumn("outcome", outcome).select("record_id", "key", "response_id", "outcome", F.when(good, merged_headers(F.col("stored"), F.col("headers"))).alias("headers"), F.when(good, F.col("payload")).alias("payload"))


def records_of(pages: DataFrame) -> DataFrame:
    """Pages as WARC records: each a full response, and a later not-modified answer, some with other validators or before any response."""
    digest = F.md5(F.col("html").cast("binary"))
    day = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    full = pages.select(
        (2 * F.col("page_id")).alias("record_id"), "url", (10 * F.col("page_id")).alias("ts"), F.lit(True).alias("full"),
        F.create_map(F.lit("ETag"), digest, F.lit("Last-Modified"), day, F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("no-cache")).alias("headers"), F.col("html").alias("payload"),
    )
    tag = F.when(F.col("page_id") % 7 == 0, "other").when(F.col("page_id") % 5 != 0, F.concat(F.lit("W/"), digest))
    back = F.when(F.col("page_id") % 11 == 0, -1).otherwise(5)
    revisit = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), (10 * F.col("page_id") + back).alias("ts"), F.lit(False).alias("full"),
        F.map_filter(F.create_map(F.lit("etag"), tag, F.lit("last-modified"), day, F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=9")), lambda _, v: v.isNotNull()).alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    return full.unionByName(revisit)


def op5_revisits(spark, sf_dir: str) -> DataFrame:
    out = resolve_revisits(records_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    line = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "; ")
    return out.select("record_id", "key", F.coalesce("response_id", F.lit(-1)).alias("response_id"), "outcome", line.alias("headers"), F.sha2("payload", 256).alias("payload_sha256"))


OP5_SQL = """
WITH p AS (SELECT page_id, html, md5(html) AS digest, 'day ' || page_id % 28 AS day,
    regexp_replace(regexp_replace(lower(regexp_extract(url, '^\\s*[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)), ':(80|443)?$', ''), '^www\\.', '') AS host,
    regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid|ref)='))) AS q FROM pages),
k AS (SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS key FROM p),
f AS (SELECT key, 10 * page_id AS ts, 2 * page_id AS response_id, digest, day, html FROM k WHERE key IS NOT NULL),
r AS (SELECT 2 * page_id + 1 AS record_id, key, 10 * page_id + CASE WHEN page_id % 11 = 0 THEN -1 ELSE 5 END AS ts, CASE WHEN page_id % 7 = 0 THEN 'other' WHEN page_id % 5 <> 0 THEN digest END AS tag, page_id % 7 <> 0 AND page_id % 5 <> 0 AS weak, day FROM k),
j AS (SELECT r.*, f.response_id, f.digest AS stored, f.day AS stored_day, f.html FROM r ASOF LEFT JOIN f ON r.key = f.key AND r.ts >= f.ts),
o AS (SELECT *, CASE WHEN key IS NULL THEN 'invalid' WHEN response_id IS NULL THEN 'missing' WHEN coalesce(tag = stored, day = stored_day) THEN 'resolved' ELSE 'changed' END AS outcome FROM j)
SELECT record_id, key, coalesce(response_id, -1) AS response_id, outcome, CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=9; content-type: text/html; etag: ' || CASE WHEN tag IS NULL THEN stored WHEN weak THEN 'W/' || tag ELSE tag END || '; last-modified: ' || day END AS headers,
  CASE WHEN outcome = 'resolved' THEN sha256(html) END AS payload_sha256 FROM o
"""
