"""Mixing sources to target weights by hash-threshold histograms, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm._state import keep, read

#: Weights of the sources in code point order, repeating; what all take together; most copies of a document.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
#: Hash bits (of 60) of the first histogram, and of the one that refines its boundary bucket.
BITS = 10
#: Source tables of up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: str, size: str) -> Column:
    """60 bits that depend on the document alone, so reruns agree on any cluster."""
    key = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(size).cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Targets of a table (source, source_size): weighted shares, stopped at MOST_COPIES times the size.

    Sharing the excess by weight again and again ends at least(cap, rate * weight), where the rate is
    the largest of those left after capping each prefix in order of cap / weight. One row for each
    source passes through one task."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(w) - 1) % len(WEIGHTS) + 1))
    cap = F.lit(MOST_COPIES) * F.col("source_size")
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    all_of = Window.partitionBy()
    done = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rates = weighed.withColumn("rate", (F.lit(SHARE) * F.sum("source_size").over(all_of) - done) / rest)
    return rates.withColumn("target", F.least(cap.cast("double"), F.max("rate").over(all_of) * F.col("weight"))).drop("rate")


def _boundary(hist: DataFrame, before: str, bucket: str) -> DataFrame:
    """Of each source, the first bucket that the budget doesn't cover, and what the ones below hold."""
    below = F.sum("n").over(Window.partitionBy("source").orderBy(bucket)) - F.col("n") + F.col(before)
    return hist.withColumn("below", below).where((F.col("below") <= F.col("budget")) & (F.col("below") + F.col("n") > F.col("budget")))


def thresholds(slim: DataFrame) -> DataFrame:
    """source, source_size, target, copies, cut: each document is taken copies times, and once more where its hash is at most cut,
    which is chosen so that the source's words come as near to the target as whole documents allow.

    slim: source, size, h. Two nested histograms leave about a millionth of a source's rows to be ordered."""
    top, low = 60 - BITS, 60 - 2 * BITS
    hist = keep(slim.groupBy("source", F.shiftright("h", top).alias("b1")).agg(F.sum("size").alias("n")), "mix-histogram")
    sources = targets(hist.groupBy("source").agg(F.sum("n").alias("source_size")))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("copies", copies).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    sources = keep(sources, "mix-sources")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    small = _sized(sources)
    first = hist.join(small, same(hist, sources)).select(hist["source"], "b1", "n", "budget", F.lit(0).alias("zero"))
    first = keep(_boundary(first, "zero", "b1").select("source", "b1", "budget", "below"), "mix-first")
    inner = slim.join(_sized(first), same(slim, first) & (F.shiftright("h", top) == F.col("b1"))).select(slim["source"], "size", "h", "b1", "budget", "below")
    second = inner.groupBy("source", "b1", "budget", F.col("below").alias("base"), F.shiftright("h", low).alias("b2")).agg(F.sum("size").alias("n"))
    second = keep(_boundary(second, "base", "b2").select("source", "b2", "budget", "below"), "mix-second")
    last = slim.join(_sized(second), same(slim, second) & (F.shiftright("h", low) == F.col("b2"))).select(slim["source"], "size", "h", "b2", "budget", "below")
    upto = last.withColumn("upto", F.col("below") + F.sum("size").over(Window.partitionBy("source").orderBy("h")))
    # Of the cuts, one below all of the bucket included, that whose sum is nearest the budget; of two the lower.
    inside = upto.groupBy("source").agg(F.min(F.struct(F.abs(F.col("upto") - F.col("budget")).alias("off"), "h")).alias("near"))
    least = F.struct((second["budget"] - second["below"]).cast("double").alias("off"), (F.shiftleft("b2", low) - 1).alias("h"))
    cuts = second.join(inside, same(second, inside), "left").select(second["source"], F.least("near", least)["h"].alias("cut"))
    none = F.lit((1 << 60) - 1)  # no bucket exceeds the budget
    return sources.join(cuts, same(sources, cuts), "left").select(sources["source"], "source_size", "target", "copies", F.coalesce("cut", none).alias("cut"))


def _sized(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def mix(docs: DataFrame) -> DataFrame:
    """docs with size, source_size, target and taken (words taken: size times 0, 1 or 2).

    One row out for each row in; extra columns stay, ours replace those of equal names. Null texts
    have size 0; null sources are a source of their own, last; rows of equal id and size share their
    fate. An empty table gives an empty one."""
    docs = docs.drop("size", "source_size", "target", "taken")
    sized = docs.withColumn("size", size_of()).withColumn("__h", hash_of("doc_id", "size"))
    cut = keep(thresholds(keep(sized.select("source", "size", F.col("__h").alias("h")), "mix-sizes")), "mix-cuts")
    cut = cut.withColumnRenamed("source", "__source").withColumnRenamed("copies", "__copies").withColumnRenamed("cut", "__cut")
    both = sized.join(_sized(cut), F.col("source").eqNullSafe(F.col("__source")))
    taken = F.col("size") * (F.col("__copies") + (F.col("__h") <= F.col("__cut")).cast("long"))
    return both.withColumn("taken", taken.cast("long")).select(*docs.columns, "size", "source_size", "target", "taken")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
h AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
r AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
    - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size::DOUBLE / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY 2 * source_size::DOUBLE / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, max(rate) OVER () * weight) AS target FROM r),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t),
o AS (SELECT h.*, c.source_size, c.target, c.copies, c.target - c.copies * c.source_size AS budget,
    sum(h.size) OVER (PARTITION BY h.source ORDER BY h.h) AS upto
  FROM h JOIN c ON h.source IS NOT DISTINCT FROM c.source),
b AS (SELECT *, first_value(upto) OVER (PARTITION BY source ORDER BY abs(upto - budget), h) AS best FROM o),
x AS (SELECT *, upto <= best AND abs(best - budget) < budget AS more FROM b)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (copies + CAST(more AS INT)) AS BIGINT) AS taken FROM x
"""


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, as the last stage: each document's columns with size, source_size, target and taken; documents of which nothing is taken go.

    Null and empty texts have size 0 and go; null sources are one source; repeated rows share their fate; an
    empty table gives an empty one. Columns of the four names are replaced."""
    return mix(docs).where(F.col("taken") > 0)
