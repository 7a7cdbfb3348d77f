"""Places and running sums over a table in an order, with no row passing one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.operators.kept import kept


def with_running(rows: DataFrame, order: list[str], size: str, name: str) -> DataFrame:
    """rows with pos (from 0) and before, the sum of `size` over the rows before, in the given order.

    Rows are sorted by range and written; then a table of each range's count and sum tells where it begins. Ties of the order take any place."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    runs = kept(runs.withColumn("_run", F.shiftright("_at", 33)), name)
    total = lambda c: F.coalesce(F.sum(c).over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each range.
    starts = runs.groupBy("_run").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_size"))
    starts = starts.select("_run", "_first", total("_n").alias("_rows"), total("_size").alias("_sum"))
    here = F.coalesce(F.sum(size).over(Window.partitionBy("_run").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = runs.withColumn("_here", here).join(starts, "_run")
    return out.withColumns({"pos": F.col("_rows") + F.col("_at") - F.col("_first"), "before": F.col("_sum") + F.col("_here")}).drop("_run", "_at", "_first", "_rows", "_sum", "_here")
