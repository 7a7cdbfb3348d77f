"""Artifacts, the call log and file hashes."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.sources.inputs import exists
from assay.sources.pieces import numbered_lines, strictly

LOG = "backend string, call_id string, latency_ms long, model string, parsed_ok boolean, prompt_hash string, provider string, replayed_call_id string, response_raw string, timestamp string, usage struct<input_tokens:long,output_tokens:long>, validation_errors array<string>"


def read_call_log(spark: SparkSession, path: str) -> DataFrame:
    """The log with line, its number from 1; a missing file is an empty log, broken lines are skipped."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{LOG}, line long")
    rows = numbered_lines(spark, path).withColumn("v", strictly(F.col("value")))
    return rows.where(F.schema_of_variant("v").startswith("OBJECT")).select(F.from_json("value", LOG).alias("e"), "line").select("e.*", "line")


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1) and value of the lines of a JSON-lines file that aren't objects; blank ones don't count."""
    rows = numbered_lines(spark, path).where(F.trim("value") != "").withColumn("v", strictly(F.col("value")))
    return rows.where(F.col("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT")).select("line", "value")


def append_call_log(path: str, entries: list[dict]) -> None:
    """Append entries of one judge stage, a line each, keys sorted; no entries leave the file alone."""
    if entries:
        with Path(path).open("a", encoding="utf-8") as out:
            out.writelines(json.dumps(e, sort_keys=True) + "\n" for e in entries)


def file_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, sha256 of files in any store."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"))
