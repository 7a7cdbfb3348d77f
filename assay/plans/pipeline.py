"""The whole evaluation as one plan: retrieval, checks, judge, taxonomy, decision."""

from __future__ import annotations

import datetime
import platform
import subprocess
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators.aggregate import recommendation, tradeoffs, verdicts
from assay.operators.batches import judge_in_batches
from assay.operators.checks import score_answers
from assay.operators.judge import long_reviews, run_judge
from assay.operators.kept import kept
from assay.operators.retrieval import bm25_topk, passages
from assay.operators.taxonomy import failure_tags
from assay.operators.validate import retrieval_counts, union, unprocessed_answers
from assay.plans.config import config_hash
from assay.sources.artifacts import append_call_log, file_hashes, read_call_log
from assay.sources.inputs import Inputs, load_inputs
from assay.sources.sinks import write_array, write_pieces


@dataclass
class Evaluation:
    """The tables of a run, each written once, as several later stages read them."""

    inputs: Inputs
    retrieval: DataFrame
    scores: DataFrame
    reviews: DataFrame
    tags: DataFrame
    verdicts: DataFrame
    decision: DataFrame
    tradeoffs: DataFrame
    backend: str
    calls: list[dict] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)
    batch_calls: DataFrame | None = None


def evaluate(inputs: Inputs, config: dict, log: DataFrame | None = None, live: Callable[[str, str, dict], str] | None = None, batch_tokens: int | None = None) -> Evaluation:
    """All stages over loaded inputs. Reviews come by one call, made on the driver, or with batch_tokens by prompts of so many tokens, asked for in tasks;
    then the calls are the table batch_calls, and the backend names all that gave reviews."""
    queries, answers, seconds = inputs.queries, inputs.answers, {}

    def timed(name: str, table: DataFrame) -> DataFrame:
        began = time.monotonic()
        table = kept(table, name)
        seconds[name] = round(time.monotonic() - began, 4)
        return table

    retrieval = timed("retrieval", passages(bm25_topk(inputs.kb, queries, config["retrieval"]), inputs.kb, queries))
    scores = timed("automated_scores", score_answers(queries, answers, retrieval, config))
    began = time.monotonic()
    batch_calls = None
    if batch_tokens:
        judged = judge_in_batches(queries, answers, retrieval, scores, config, log, live, batch_tokens)
        backend = ", ".join(sorted(r.backend for r in judged.reviews.select("backend").distinct().collect()))  # three at most
        reviews, calls, batch_calls = judged.reviews.drop("batch", "backend"), [], judged.calls
    else:
        reviews, backend, calls = run_judge(queries, answers, retrieval, scores, config, log, live)
    reviews = kept(reviews, "reviews")
    seconds["llm_review"] = round(time.monotonic() - began, 4)
    long = long_reviews(reviews)
    tags = timed("failure_taxonomy", failure_tags(scores, queries, answers, long, config))
    verdict = timed("recommendation", verdicts(scores, queries, long, tags, config))
    decided = kept(recommendation(verdict, config), "decision")
    return Evaluation(inputs, retrieval, scores, reviews, tags, verdict, decided, tradeoffs(verdict, decided), backend, calls, seconds, batch_calls)


def recommendation_markdown(run: Evaluation) -> str:
    return recommendation_text(run.verdicts, run.decision, run.tradeoffs, run.backend)


def recommendation_text(verdict: DataFrame, decision: DataFrame, clearer: DataFrame, backend: str) -> str:
    """The decision in words. Only tables of one row for each variant are collected."""
    one, rows = decision.first(), verdict.orderBy("variant").collect()
    lines = ["# Recommendation", "", f"Selected variant: {one.selected_variant or 'none'}", f"Judge backend: {backend}", "", "| variant | composite | gate | clarity | faithfulness | wins |", "|---|---|---|---|---|---|"]
    lines += [f"| {r.variant} | {r.composite_score} | {'disqualified' if r.disqualified else 'passes'} | {r.mean_clarity} | {r.mean_faithfulness} | {r.judge_wins} |" for r in rows]
    lines += ["", "## Why", ""] + [f"- {r.variant} is out: {'; '.join(r.reasons)}" for r in rows if r.disqualified]
    if not one.n_candidates:
        lines.append("- no variant passes the safety gate")
    elif one.n_candidates == 1:
        lines.append(f"- {one.selected_variant} alone passes the safety gate")
    else:
        lines.append(f"- margin over {one.runner_up}: {one.margin}" + ("" if one.selected_variant else ", too small to prefer one"))
    lines += [f"- {r.variant} reads more clearly than {r.target} ({r.mean_clarity} against {r.target_clarity}) but fails the gate" for r in clearer.orderBy("variant").collect()]
    lines += ["", "## Failure tags", ""] + [f"- {r.variant}: " + (", ".join(f"{k} {v}" for k, v in sorted(r.failure_tag_counts.items())) or "none") for r in rows]
    return "\n".join(lines) + "\n"


def report_lines(run: Evaluation) -> DataFrame:
    """q_ord, query_id, section: the review report, a section for each query, made on the executors."""
    line = F.concat(F.lit("- **"), F.col("variant"), F.lit("**: "), F.coalesce("answer", F.lit("")), F.lit("\n  - grounding "), F.col("grounding_score").cast("string"), F.lit("; flags "), F.array_join("risk_flags", ", "), F.lit("; tags "), F.when(F.size("tags") == 0, "none").otherwise(F.array_join("tags", ", ")), F.lit("\n  - "), F.col("notes"))
    rows = run.inputs.answers.join(run.scores, ["query_id", "variant"]).join(run.tags, ["query_id", "variant"], "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    body = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("variant", line.alias("line")))).alias("x")).select("query_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("body"))
    seen = run.retrieval.select("query_id", F.array_join(F.transform("retrieved", lambda p: F.concat(p["doc_id"], F.lit(" ("), p["score"].cast("string"), F.lit(")"))), ", ").alias("evidence"))
    judged = run.reviews.select("query_id", F.concat(F.lit("Judge: "), F.col("winner"), F.lit(". "), F.coalesce("justification", F.lit(""))).alias("judge"))
    out = run.inputs.queries.join(body, "query_id", "left").join(seen, "query_id", "left").join(judged, "query_id", "left")
    section = F.concat_ws("\n\n", F.concat(F.lit("## "), F.col("query_id"), F.lit(" ("), F.col("risk_level"), F.lit(")")), "user_question", F.concat(F.lit("Evidence: "), F.coalesce("evidence", F.lit("none"))), F.coalesce("body", F.lit("No answers.")), "judge")
    return out.select("q_ord", "query_id", section.alias("section"))


def manifest(spark: SparkSession, run: Evaluation, config: dict, paths: dict[str, str]) -> dict:
    """What a run was made of."""
    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        commit = None
    judge = config["judge"]
    return {
        "generated_at": datetime.datetime.now(datetime.UTC).isoformat(),
        "git_commit": commit,
        "config_hash": config_hash(config),
        "input_hashes": {name: file_hashes(spark, [path]).first().sha256 for name, path in paths.items()},
        "python_version": platform.python_version(),
        "judge": {"provider": judge.get("provider"), "model": judge["model"], "backend_order": judge["backend_order"], "backend_used": run.backend},
        "counts": {"documents": run.inputs.kb.count(), "queries": run.inputs.queries.count(), "variants": run.verdicts.count()},
        "stage_timings_seconds": run.seconds,
    }


def run_files(spark: SparkSession, paths: dict[str, str], out: str, config: dict, live: Callable[[str, str, dict], str] | None = None, batch_tokens: int | None = None) -> Evaluation:
    """Load, evaluate and write every artifact into the folder out. paths: kb, queries, answers, and llm_calls for the call log."""
    import json

    inputs = load_inputs(spark, paths["kb"], paths["queries"], paths["answers"])
    log = read_call_log(spark, paths["llm_calls"]) if "llm_calls" in paths else None
    run = evaluate(inputs, config, log, live, batch_tokens)
    if "llm_calls" in paths:
        append_call_log(paths["llm_calls"], run.calls)
    q = inputs.queries.select("query_id", "q_ord")
    order = inputs.answers.groupBy("variant").agg(F.min(F.struct("a_ord", "v_pos")).alias("v_ord"))
    Path(out).mkdir(parents=True, exist_ok=True)
    write_array(run.retrieval.join(q, "query_id"), f"{out}/retrieval.json", ["q_ord"])
    for name, table in (("automated_scores", run.scores), ("failure_taxonomy", run.tags)):
        write_array(table.join(q, "query_id").join(order, "variant").select(*table.columns, "q_ord", "v_ord"), f"{out}/{name}.json", ["q_ord", "v_ord"])
    if run.batch_calls is not None:
        write_pieces(run.batch_calls, f"{out}/batch_calls.jsonl", ["batch", "backend"], F.to_json(F.struct(*run.batch_calls.columns)), "", "\n", "\n")
    write_array(run.reviews.join(q, "query_id"), f"{out}/llm_review.json", ["q_ord"])
    Path(f"{out}/recommendation.md").write_text(recommendation_markdown(run), encoding="utf-8")
    write_pieces(report_lines(run), f"{out}/review_report.md", ["q_ord"], F.concat(F.lit("\n"), "section"), "# Review report\n", "\n", "\n")
    Path(f"{out}/run_manifest.json").write_text(json.dumps(manifest(spark, run, config, {k: v for k, v in paths.items() if k != "llm_calls"}), indent=2) + "\n", encoding="utf-8")
    return run


def run_issues(run: Evaluation, config: dict) -> DataFrame:
    """Coverage of a run: answers without a score, queries with another number of passages than asked for."""
    return union([unprocessed_answers(run.inputs.answers, run.scores), retrieval_counts(run.inputs.queries, run.retrieval, run.inputs.kb, config["retrieval"]["top_k"])])
