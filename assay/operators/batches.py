"""Reviews in batches: as many prompts as the questions need, replayed, asked for and checked side by side.

Blocks of questions are packed into prompts by a budget of tokens over running sums, one row a prompt. One join finds the
prompts that the log can replay; only the others are asked for, in tasks, and each round's answers are written before they are
checked, so that a later step never asks again."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.operators.judge import REVIEW, SYSTEM_PROMPT, JudgeUnavailable, build_prompt, cached_calls, prompt_hash_column, repaired, review_issues, stub_payload
from assay.operators.kept import kept
from assay.operators.ordered import with_running

#: Tokens of a prompt, of which four characters make one; a prompt has one block more at most.
BATCH_TOKENS = 6000
ANSWER = "batch long, response string, error string, gone boolean"
FIELDS = [f.split()[0] for f in REVIEW.split(", ")]


@dataclass
class BatchReviews:
    """reviews: as REVIEW, with batch and backend. calls: batch, backend, prompt_hash, replayed_call_id, response_raw, parsed_ok, validation_errors of every try."""

    reviews: DataFrame
    calls: DataFrame


def prompt_batches(blocks: DataFrame, judge: dict, tokens: int = BATCH_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(batch, prompt, prompt_hash, n of each prompt; batch, query_id of each block).

    blocks: query_id, q_ord, block, as build_prompt() gives them. A block is in the batch that its start falls in, counted in budgets
    of tokens; so batches follow the order of questions, and no task sums up all of them. Batch numbers may leave gaps behind long blocks."""
    sized = blocks.withColumn("size", F.ceil(F.length("block") / 4).cast("long"))
    placed = with_running(sized, ["q_ord", "query_id"], "size", "prompt-blocks").withColumn("batch", F.floor(F.col("before") / tokens).cast("long"))
    placed = kept(placed.select("batch", "pos", "query_id", "block"), "prompt-places")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "\n")
    prompts = placed.groupBy("batch").agg(text.alias("prompt"), F.count(F.lit(1)).alias("n"))
    return kept(prompts.withColumn("prompt_hash", prompt_hash_column(F.col("prompt"), judge)), "prompts"), placed.select("batch", "query_id")


def _asked(prompts: DataFrame, live: Callable[[str, str, dict], str], judge: dict) -> DataFrame:
    """ANSWER of each prompt. A call that fails costs its own batch only."""

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for batch, prompt in zip(frame["batch"], frame["prompt"], strict=True):
                try:
                    rows.append((batch, live(SYSTEM_PROMPT, prompt, judge), None, False))
                except JudgeUnavailable as error:
                    rows.append((batch, None, str(error), True))
                except Exception as error:  # noqa: BLE001, a call that failed is logged and may be repeated
                    rows.append((batch, None, str(error), False))
            yield pd.DataFrame(rows, columns=["batch", "response", "error", "gone"])

    return prompts.select("batch", "prompt").mapInPandas(call, ANSWER)


def judge_in_batches(
    queries: DataFrame, answers: DataFrame, retrieval: DataFrame, scores: DataFrame, config: dict, log: DataFrame | None = None, live: Callable[[str, str, dict], str] | None = None, tokens: int = BATCH_TOKENS,
    batches: tuple[DataFrame, DataFrame] | None = None,
) -> BatchReviews:
    """Reviews of all answered queries by the configuration's backends, each batch by the first one whose answer holds.

    A live batch is asked max_retries times more, with what was wrong. `live` runs in tasks and must be picklable; a task that is lost before its
    answers are written asks again. A batch that no backend answers is an error, which names how many there are. batches: what prompt_batches() gave
    for the same tables, where it was called before. answers and scores are read several times: keep them first where they cost much."""
    spark, judge = queries.sparkSession, config["judge"]
    low, high = judge["score_min"], judge["score_max"]
    prompts, members = batches or prompt_batches(build_prompt(queries, answers, retrieval, scores), judge, tokens)
    rest, reviews, calls = prompts, [], []
    kinds = "batch long, backend string, prompt_hash string, replayed_call_id string, response_raw string, parsed_ok boolean, validation_errors array<string>"

    def checked(payloads: DataFrame, backend: str) -> tuple[DataFrame, DataFrame]:
        """Logs all payloads (batch, prompt, prompt_hash, call_id, response, error, gone), takes those that hold; (batches done, those that failed with their errors)."""
        problems = review_issues(payloads.where("response IS NOT NULL").select("batch", "response"), members, answers, low, high, ("batch",))
        problems = problems.groupBy("batch").agg(F.sort_array(F.collect_list(F.concat_ws(": ", "query_id", "problem"))).alias("errors"))
        errors = F.when(F.col("response").isNull(), F.array(F.coalesce("error", F.lit("no answer")))).otherwise(F.coalesce("errors", F.array().cast("array<string>")))
        all_of = kept(payloads.join(problems, "batch", "left").withColumn("errors", errors), f"judged-{backend}")
        calls.append(all_of.select("batch", F.lit(backend).alias("backend"), "prompt_hash", F.col("call_id").alias("replayed_call_id"), F.col("response").alias("response_raw"), (F.size("errors") == 0).alias("parsed_ok"), F.col("errors").alias("validation_errors")))
        good = all_of.where(F.size("errors") == 0)
        entries = good.select("batch", F.explode(F.from_json("response", f"reviews array<struct<{REVIEW}>>")["reviews"]).alias("r")).select("batch", "r.*")
        reviews.append(entries.withColumns({"justification": F.trim("justification"), "backend": F.lit(backend)}))
        return good.select("batch"), all_of.where(F.size("errors") > 0)

    for backend in judge["backend_order"]:
        if backend == "cache" and log is not None:
            hits = rest.join(cached_calls(log, rest), "prompt_hash").select("batch", "prompt", "prompt_hash", "call_id", F.col("response_raw").alias("response"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("gone"))
            # The checks read the payloads several times; the log is read once.
            done, _ = checked(kept(hits, "cache-hits"), "cache")
            rest = rest.join(done, "batch", "left_anti")
        elif backend == "live" and live is not None:
            ask = rest.select("batch", "prompt", "prompt_hash", F.col("prompt").alias("first"))
            for _ in range(judge["max_retries"] + 1):
                if not ask.limit(1).count():
                    break
                said = kept(_asked(ask, live, judge), "live-answers")
                done, failed = checked(ask.join(said, "batch").withColumn("call_id", F.lit(None).cast("string")).drop("prompt").withColumnRenamed("first", "prompt"), "live")
                rest = rest.join(done, "batch", "left_anti")
                ask = failed.where("NOT gone").select("batch", repaired(F.col("prompt"), F.col("errors")).alias("prompt"), "prompt_hash", F.col("prompt").alias("first"))
        elif backend == "stub":
            own = members.join(rest.select("batch"), "batch", "left_semi")
            made = stub_payload(spark, answers.join(own, "query_id", "left_semi"), scores, judge).join(own, "query_id")
            reviews.append(made.select("batch", *FIELDS, F.lit("stub").alias("backend")))
            calls.append(rest.select("batch", F.lit("stub").alias("backend"), "prompt_hash", F.lit(None).cast("string").alias("replayed_call_id"), F.lit(None).cast("string").alias("response_raw"), F.lit(True).alias("parsed_ok"), F.array().cast("array<string>").alias("validation_errors")))
            rest = rest.limit(0)
            break
    if lost := rest.count():
        raise RuntimeError(f"no judge backend gave valid reviews for {lost} batches")
    union = lambda tables, schema: reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], schema)
    return BatchReviews(kept(union(reviews, f"batch long, {REVIEW}, backend string"), "batch-reviews"), kept(union(calls, kinds), "batch-calls"))
