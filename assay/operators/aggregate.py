"""Safety gate, composite scores, and the decision which variant to promote."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.grounding import rounded
from assay.operators.taxonomy import severity


def contributions(scores: DataFrame, queries: DataFrame, reviews: DataFrame, config: dict) -> DataFrame:
    """scores with risk_level, q_ord, review columns, contribution and gated.

    A score without a review loses the review's share of the composite, and counts for no mean."""
    w, judge = config["aggregation"]["weights"], config["judge"]
    low, span = judge["score_min"], max(1, judge["score_max"] - judge["score_min"])
    rows = scores.join(queries.select("query_id", "q_ord", "risk_level"), "query_id").join(reviews.select("query_id", "variant", "faithfulness", "clarity", "winner"), ["query_id", "variant"], "left")
    part = lambda c, name: F.col(c).cast("int") * F.lit(float(w[name]))
    scale = lambda c, name: F.coalesce((F.col(c) - low) / span, F.lit(0.0)) * F.lit(float(w[name]))
    total = part("retrieval_hit", "retrieval_hit") + part("must_include_pass", "must_include_pass") + part("must_not_claim_pass", "must_not_claim_pass") + F.col("grounding_score") * F.lit(float(w["grounding_score"]))
    total = total + scale("faithfulness", "judge_faithfulness") + scale("clarity", "judge_clarity") + F.coalesce((F.col("winner") == F.col("variant")).cast("int"), F.lit(0)) * F.lit(float(w["judge_winner_vote"]))
    gate = ~F.col("must_not_claim_pass") & (severity(F.col("risk_level"), config["risk"]) >= config["gates"]["disqualify_must_not_claim_at_severity"])
    return rows.withColumn("contribution", total).withColumn("gated", gate)


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.select("variant", F.explode("tags").alias("tag")).groupBy("variant", "tag").agg(F.count(F.lit(1)).alias("n"))


def verdicts(scores: DataFrame, queries: DataFrame, reviews: DataFrame, tags: DataFrame, config: dict, shift: float = 0.0) -> DataFrame:
    """variant, disqualified, reasons, composite_score, mean_clarity, mean_faithfulness, judge_wins, failure_tag_counts.

    Sums are made before the shuffle; only gated answers, which are named as reasons, are listed."""
    rows = contributions(scores, queries, reviews, config)
    # Fixed value: the format of a reason.
    reason = F.concat(F.lit("must_not_claim violation on "), F.col("query_id"), F.lit(" (risk "), F.coalesce("risk_level", F.lit("unknown")), F.lit(")"))
    totals = rows.groupBy("variant").agg(
        F.bool_or("gated").alias("disqualified"),
        rounded(F.avg("contribution"), config["aggregation"]["score_precision"], shift).alias("composite_score"),
        rounded(F.avg("clarity"), 2, shift).alias("mean_clarity"),
        rounded(F.avg("faithfulness"), 2, shift).alias("mean_faithfulness"),
        F.count_if(F.col("winner") == F.col("variant")).alias("judge_wins"),
    )
    reasons = rows.where("gated").groupBy("variant").agg(F.array_sort(F.collect_list(F.struct("q_ord", reason.alias("r")))).alias("x")).select("variant", F.transform("x", lambda x: x["r"]).alias("reasons"))
    counts = tag_counts(tags).groupBy("variant").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "n")))).alias("failure_tag_counts"))
    out = totals.join(reasons, "variant", "left").join(counts, "variant", "left")
    return out.withColumns({"reasons": F.coalesce("reasons", F.array().cast("array<string>")), "failure_tag_counts": F.coalesce("failure_tag_counts", F.create_map().cast("map<string,bigint>"))})


def recommendation(verdict: DataFrame, config: dict, shift: float = 0.0) -> DataFrame:
    """One row: selected_variant, margin, n_candidates, runner_up.

    One surviving variant is selected; of more, the best only if its margin over the next is large
    enough. verdict has a row for each variant, few by nature."""
    cut, digits = config["aggregation"]["min_margin_for_promotion"], config["aggregation"]["score_precision"]
    order = Window.orderBy(F.desc("composite_score"), "variant")
    ranked = verdict.where("NOT disqualified").select("variant", "composite_score", F.row_number().over(order).alias("rank"))
    pick = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    one = ranked.agg(F.count(F.lit(1)).alias("n_candidates"), pick("variant", 1).alias("top"), pick("variant", 2).alias("runner_up"), rounded(pick("composite_score", 1) - pick("composite_score", 2), digits, shift).alias("margin"))
    chosen = F.when((F.col("n_candidates") == 1) | (F.col("margin") >= cut), F.col("top"))
    return one.select(chosen.alias("selected_variant"), "margin", "n_candidates", "runner_up")


def tradeoffs(verdict: DataFrame, decided: DataFrame) -> DataFrame:
    """variant, target, mean_clarity, target_clarity: disqualified variants judged clearer than the target.

    The target is the selected variant, or else the first survivor by name."""
    first = verdict.where("NOT disqualified").agg(F.min("variant").alias("first"))
    target = decided.join(first).select(F.coalesce("selected_variant", "first").alias("target"))  # one row
    clear = verdict.select(F.col("variant").alias("target"), F.col("mean_clarity").alias("target_clarity")).join(F.broadcast(target), "target")
    return verdict.where("disqualified").join(F.broadcast(clear)).where(F.col("mean_clarity") > F.col("target_clarity")).select("variant", "target", "mean_clarity", "target_clarity")
