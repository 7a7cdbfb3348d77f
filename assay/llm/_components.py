"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm._state import drop, keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), a < b. Links the larger (large) or the smaller neighbours of each node to its least neighbour."""
    one = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = one.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.withColumn("m", F.least("u", "m"))
        out = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = both.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a < b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root (its component's least node) of all nodes that have an edge; edges: a, b longs in any order.

    Ends when every node hangs on its root alone, after a logarithmic number of rounds. The minimum
    of a hub's neighbours is pre-aggregated, and the joins are ones that adaptive execution can split."""
    now = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), name)
    while True:
        # A forest of stars: no node has two parents, and no parent has one.
        bad = now.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("b").unionByName(now.join(now.select(F.col("b").alias("a")), "a", "left_semi").select("b"))
        if not bad.limit(1).count():
            break
        new = keep(_star(_star(now, True), False), name)
        drop(now)
        now = new
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
