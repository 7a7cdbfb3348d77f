"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assay.llm._state import drop, keep
from assay.llm.decontaminate import decontaminate_stage
from assay.llm.line_dedup import line_dedup_stage
from assay.llm.mixing import mixing_stage
from assay.llm.quality_knn import quality_stage
from assay.llm.sketch_join import jaccard_stage

STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources", mixing_stage),
]
#: The classifier's votes and the edit distances of decontamination can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Each stage's table goes once the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
