"""Divergence of sources: term counts and pair sums by DuckDB in shards, merged by Spark.

A map task's DuckDB tokenises and counts slices of documents; the counts are dealt out by lang and term, so a shard has
all counts of its terms. Its DuckDB adds them up, keeps the terms of enough documents and, once Spark has the sums of all
shards, turns counts into smoothed shares: each shard gives partial sums for the pairs of sources and its own best
terms, and Spark merges sums and ranks. All arithmetic is on integers."""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm._state import keep, read
from assay.llm._text import parts, utf8

#: A term counts in a lang where so many of its documents hold it; terms are ranked down to TOP.
LEAST_DOCS, TOP = 30, 50
#: Bytes of text that DuckDB counts at once, and counts of terms that are a shard of the second pass.
SLICE_BYTES, SHARD_ROWS = 32 << 20, 200_000
#: Scale of a share, and what is added to every count.
SCALE, PLUS = 1_000_000_000, 5
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
PART = "lang string, term string, docs long, sources array<string>, counts array<long>"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _duck() -> duckdb.DuckDBPyConnection:
    """A connection in memory with one thread, as a task has one core; it writes no files."""
    return duckdb.connect(config={"threads": 1, "temp_directory": ""})


def _plain(table: pa.Table, names: str) -> list[pa.RecordBatch]:
    """Batches of a DuckDB result, as the types Spark asked for."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split(" ") for x in names.split(", "))])
    return table.select(schema.names).cast(schema).combine_chunks().to_batches(max_chunksize=1 << 16)


def partial_counts(docs: DataFrame) -> DataFrame:
    """PART: of each slice's terms, by lang, how many documents hold them and how often each source does."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        for b in batches:
            for i, j, off, data in parts(b.column("text"), SLICE_BYTES, 1 << 20):
                text = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(off.tobytes()), pa.py_buffer(_LOWER[data].tobytes()))
                d = pa.table({"r": np.arange(j - i), "lang": b.column("lang").slice(i, j - i), "source": b.column("source").slice(i, j - i), "text": text})  # noqa: F841
                yield from _plain(
                    con.sql(f"""WITH t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM d),
                    a AS (SELECT r, lang, source, term, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT lang, source, term, count(*) AS docs, sum(n) AS n FROM a GROUP BY ALL)
                    SELECT lang, term, sum(docs) AS docs, list(source) AS sources, list(n) AS counts FROM s GROUP BY ALL""").to_arrow_table(),
                    PART,
                )

    return docs.select("lang", "source", "text").mapInArrow(count, PART)


COUNT = "lang string, source string, term string, n long"


def kept_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """COUNT: how often each source of a lang has each of the lang's terms that are in least_docs of its documents; counts of 0 are left out.

    Shards are as many as the scan has partitions or a shuffle has, so a shard is about as large as a partition."""
    spark = docs.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        con.execute("CREATE TABLE part (lang VARCHAR, term VARCHAR, docs BIGINT, sources VARCHAR[], counts BIGINT[])")
        for b in batches:
            one = pa.Table.from_batches([b])  # noqa: F841
            con.execute("INSERT INTO part SELECT lang, term, docs, sources, counts FROM one")
        yield from _plain(
            con.sql(f"""WITH k AS (SELECT lang, term FROM part GROUP BY ALL HAVING sum(docs) >= {least_docs}),
            u AS (SELECT lang, term, unnest(sources) AS source, unnest(counts) AS n FROM part SEMI JOIN k USING (lang, term))
            SELECT lang, source, term, sum(n) AS n FROM u GROUP BY ALL""").to_arrow_table(),
            COUNT,
        )

    return partial_counts(docs).repartition(shards, "lang", "term").mapInArrow(add, COUNT)


FOUND = "lang string, source string, part string, item string, value long"
_SHARE = f"CAST(1 + ({SCALE}::HUGEINT * ({{}} + {PLUS})) // ({{}} + {PLUS} * v) AS BIGINT)"
_SHARD = f"""
WITH g AS (SELECT lang, source, n AS own, v, total FROM s WHERE term IS NULL), c AS (SELECT lang, source, term, n FROM s WHERE term IS NOT NULL),
t AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS every FROM c GROUP BY ALL)
SELECT t.lang, t.term, g.source, coalesce(c.n, 0) AS n, {_SHARE.format('coalesce(c.n, 0)', 'own')} AS p, {_SHARE.format('every', 'total')} AS q
FROM t JOIN g USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.term = t.term AND c.source = g.source"""


def _shards(counts: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """FOUND, unmerged: partial sums of pairs, one way round, and the best terms of each shard. groups (lang, source, n, v, total)
    goes to each shard through the shuffle, so nothing is broadcast."""
    shards = -(-counts.count() // SHARD_ROWS)
    rows = counts.select(F.pmod(F.xxhash64("lang", "term"), F.lit(max(1, shards))).cast("int").alias("shard"), "lang", "source", "term", "n", F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("total"))
    every = groups.select(F.explode(F.sequence(F.lit(0), F.lit(max(1, shards) - 1))).alias("shard"), "lang", "source", F.lit(None).cast("string").alias("term"), "n", "v", "total")

    def work(table: pa.Table) -> pa.Table:
        con = _duck()
        s = table  # noqa: F841
        con.execute(f"CREATE TABLE p AS {_SHARD}")
        con.execute("CREATE TABLE f AS SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL")
        con.execute(f"INSERT INTO f SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {top}")
        return pa.Table.from_batches(_plain(con.sql("SELECT * FROM f").to_arrow_table(), FOUND), schema=pa.schema([(n, pa.int64() if n == "value" else pa.string()) for n in ("lang", "source", "part", "item", "value")]))

    return rows.unionByName(every).groupBy("shard").applyInArrow(work, FOUND)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a lang is from the others and from the lang.

    docs: lang, source, text; nulls count as empty, other columns are left alone. Terms are runs of ASCII letters and
    characters beyond ASCII, A-Z lower-cased; a lang keeps those in least_docs of its documents. A count c of N kept ones becomes
    the share 1 + floor(10**9 (c + 5) / (N + 5 V)), V being the lang's number of kept terms. Part `pair`: to each other source the sum of
    differences of shares over all kept terms (0 without any). Part `term`: terms that the source has and whose share is above the
    lang's, by the difference, to rank `top`. Ties rank by item as UTF-8 bytes. Repeated rows are documents of their own; an empty table gives an empty
    one; a lang with one source has no pairs. There are as many pairs as the result has rows of them."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = keep(kept_counts(docs, least_docs), "audit-counts")
    lang = counts.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.sum("n").alias("total"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(lang, "lang", "left")
    groups = keep(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "total"))), "audit-groups")
    found = keep(_shards(counts, groups, top), "audit-shards")
    one = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where("source <> item")
    pairs = pairs.join(one.unionByName(one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")), ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(found.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


def op13_source_audit(spark, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


_SQL_P = "CAST(1 + (1000000000::HUGEINT * ({} + 5)) // ({} + 5 * v) AS BIGINT)"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS every FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, CAST(sum(every) AS BIGINT) AS total FROM k GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0) AS own FROM (SELECT DISTINCT lang, source FROM d) d),
p AS (SELECT k.lang, k.term, g.source, coalesce(n, 0) AS n, {_SQL_P.format('coalesce(n, 0)', 'own')} AS p, {_SQL_P.format('every', 'total')} AS q
  FROM k JOIN l USING (lang) JOIN g USING (lang) LEFT JOIN c ON c.lang = k.lang AND c.term = k.term AND c.source = g.source),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f QUALIFY part = 'pair' OR rank <= 50
"""
