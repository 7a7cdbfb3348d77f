"""The bounded samples of labelled documents that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_texts(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """doc_id, quality, text of at most per_class labelled documents of each class, the same ones in every run.

    labels: doc_id, quality; rows with a null id or with another quality than 0 and 1 are left out, and of
    several of one document the lowest counts. Of several texts of one id the one with the least hash is taken."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = [own.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    # At most 2 * per_class rows, whatever the input.
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    one = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    return one.select("doc_id", "quality", "one.text")
