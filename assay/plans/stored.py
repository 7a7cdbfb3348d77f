"""Checks of a stored run: its artifacts as tables, and every fault an issue."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators.aggregate import recommendation, tradeoffs, verdicts
from assay.operators.judge import long_reviews, review_entry_issues
from assay.operators.validate import differences, issues, retrieval_counts, union, unprocessed_answers
from assay.plans.pipeline import recommendation_text
from assay.sources.artifacts import broken_lines
from assay.sources.inputs import Inputs, exists, read_array

TEXT = "STRING"
WHOLE = "BIGINT"
NUMBER = "(BIGINT|DECIMAL|DOUBLE)"
#: Fields of the records of each artifact, and how the type of their JSON value begins.
RECORDS: dict[str, dict[str, str]] = {
    "retrieval": {"query_id": TEXT, "retrieved": "ARRAY"},
    "automated_scores": {"query_id": TEXT, "variant": TEXT, "retrieval_hit": "BOOLEAN", "must_include_pass": "BOOLEAN", "must_not_claim_pass": "BOOLEAN", "grounding_score": NUMBER, "risk_flags": "ARRAY"},
    "llm_review": {"query_id": TEXT, "winner": TEXT, "faithfulness": "OBJECT", "clarity": "OBJECT", "overclaim_flags": "OBJECT", "justification": TEXT},
    "failure_taxonomy": {"query_id": TEXT, "variant": TEXT, "tags": "ARRAY"},
}
TYPES = {
    "retrieval": "query_id string, retrieved array<struct<doc_id:string,score:double,title:string,text:string>>",
    "automated_scores": "query_id string, variant string, retrieval_hit boolean, must_include_pass boolean, must_not_claim_pass boolean, grounding_score double, risk_flags array<string>, notes string",
    "llm_review": "query_id string, winner string, faithfulness map<string,int>, clarity map<string,int>, overclaim_flags map<string,boolean>, justification string",
    "failure_taxonomy": "query_id string, variant string, tags array<string>",
}


def _one(spark: SparkSession, code: str, path: str, message: str) -> DataFrame:
    return issues(spark.createDataFrame([(path,)], "p string"), code, F.col("p"), F.lit(message))


def record_issues(rows: DataFrame, path: str, fields: dict[str, str]) -> DataFrame:
    """Records (idx, record of read_array()) that are no objects, and fields that are missing or of another type."""
    place = F.concat(F.lit(f"{path}["), F.col("idx").cast("string"), F.lit("]"))
    is_object = F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False))
    kind: dict[str, Column] = {f: F.coalesce(F.schema_of_variant(F.try_variant_get("record", f"$.{f}", "variant")), F.lit("VOID")) for f in fields}
    bad = F.array_compact(F.array(*(F.when(~F.regexp(kind[f], F.lit(f"^{t}")), F.lit(f)) for f, t in fields.items())))
    wrong = rows.where(is_object).select("idx", F.explode(bad).alias("f"))
    return issues(rows.where(~is_object), "NOT_AN_OBJECT", place, F.lit("record is no object")).unionByName(
        issues(wrong, "SCHEMA_INVALID", F.concat(place, F.lit("."), F.col("f")), F.lit("missing or of another type"))
    )


def read_records(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(the sound records of an array artifact as TYPES, with idx and entry, their JSON; its issues)."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"idx int, entry string, {TYPES[name]}"), _one(spark, "MISSING_ARTIFACT", path, "no such file")
    rows, bad = read_array(spark, path)
    if not bad.limit(1).count() and not rows.limit(1).count():
        bad = _one(spark, "EMPTY_ARTIFACT", path, "no record")
    found = record_issues(rows, path, RECORDS[name])
    faulty = found.select(F.regexp_extract("location", r"\[(\d+)\]", 1).cast("int").alias("idx")).distinct()
    sound = rows.join(faulty, "idx", "left_anti").select("idx", F.to_json("record").alias("entry"))
    return sound.select("idx", "entry", F.from_json("entry", TYPES[name]).alias("r")).select("idx", "entry", "r.*"), bad.unionByName(found)


def stored_differences(spark: SparkSession, path: str, name: str, computed: DataFrame) -> DataFrame:
    """Issues of a stored artifact against the same table computed again: its own, and records that only one of both has."""
    records, bad = read_records(spark, path, name)
    fields = [c for c in records.columns if c not in ("idx", "entry") and c in computed.columns]
    kinds = {f.name: f.dataType for f in records.schema.fields}
    again = computed.select(*(F.col(c).cast(kinds[c]).alias(c) for c in fields))
    return bad.unionByName(differences(records.select(*fields), again))


def line_issues(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a JSON-lines file that aren't objects, by number from 1; a missing file has none."""
    if not exists(spark, path):
        return _one(spark, "", path, "").limit(0)
    return issues(broken_lines(spark, path), "INVALID_JSON", F.concat(F.lit(f"{path}:"), F.col("line").cast("string")), F.lit("no JSON object"))


def _text_issues(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return _one(spark, "MISSING_ARTIFACT", path, "no such file")
    blank = spark.read.text(path, wholetext=True).agg(F.coalesce(F.max(F.regexp("value", F.lit(r"\S"))), F.lit(False)).alias("some"))
    return issues(blank.where("NOT some"), "EMPTY_ARTIFACT", F.lit(path), F.lit("nothing written"))


def stored_run_issues(spark: SparkSession, inputs: Inputs, paths: dict[str, str], config: dict) -> DataFrame:
    """All issues of the artifacts in paths: code, location, message, severity; no row means that the run holds.

    paths: retrieval, automated_scores, llm_review, failure_taxonomy, recommendation, review_report,
    llm_calls, run_manifest. Checked are: that artifacts are there and well-formed; that each answer was
    scored; that each query has its passages; that reviews are valid; and that the decision follows again
    from the stored tables. An artifact without sound records costs the checks that need it, and is an issue itself."""
    tables, found = {}, []
    for name in RECORDS:
        tables[name], bad = read_records(spark, paths[name], name)
        found.append(bad)
    found += [_text_issues(spark, paths[n]) for n in ("recommendation", "review_report")]
    found.append(line_issues(spark, paths["llm_calls"]))
    backend, manifest = None, paths["run_manifest"]
    if not exists(spark, manifest):
        found.append(_one(spark, "MISSING_ARTIFACT", manifest, "no such file"))
    else:
        try:
            whole = json.loads(spark.read.text(manifest, wholetext=True).first().value)
            backend = whole["judge"]["backend_used"]
        except json.JSONDecodeError:
            found.append(_one(spark, "INVALID_JSON", manifest, "not JSON"))
        except (KeyError, TypeError, AttributeError):
            found.append(_one(spark, "MANIFEST_UNREADABLE", manifest, "no judge.backend_used"))
    some = {n: bool(t.limit(1).count()) for n, t in tables.items()}
    judge = config["judge"]
    if some["automated_scores"]:
        found.append(unprocessed_answers(inputs.answers, tables["automated_scores"]))
    if some["retrieval"]:
        found.append(retrieval_counts(inputs.queries, tables["retrieval"], inputs.kb, config["retrieval"]["top_k"]))
    if some["llm_review"]:
        entries = tables["llm_review"].select(F.col("idx").alias("pos"), "entry")
        wrong = review_entry_issues(entries, inputs.queries, inputs.answers, judge["score_min"], judge["score_max"])
        found.append(issues(wrong, "INVALID_LLM_REVIEW", F.lit(paths["llm_review"]), F.concat_ws(": ", "query_id", "problem")))
    if backend is not None and some["automated_scores"] and some["llm_review"] and some["failure_taxonomy"] and exists(spark, paths["recommendation"]):
        verdict = verdicts(tables["automated_scores"], inputs.queries, long_reviews(tables["llm_review"]), tables["failure_taxonomy"], config)
        decided = recommendation(verdict, config)
        text = recommendation_text(verdict, decided, tradeoffs(verdict, decided), backend)
        if spark.read.text(paths["recommendation"], wholetext=True).first().value != text:
            found.append(_one(spark, "RECOMMENDATION_NOT_REPRODUCIBLE", paths["recommendation"], "the stored tables give another recommendation"))
    return union(found)


def artifact_paths(out: str, llm_calls: str) -> dict[str, str]:
    """Paths of the artifacts of run_files() in a folder."""
    json_names = {n: str(Path(out) / f"{n}.json") for n in (*RECORDS, "run_manifest")}
    return json_names | {n: str(Path(out) / f"{n}.md") for n in ("recommendation", "review_report")} | {"llm_calls": llm_calls}
