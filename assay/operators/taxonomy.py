"""Failure tags of every scored answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that mark an overconfident tone, and the tags in their order. A mark that ends in
# a sign is seen only where a word character follows it.
MARKERS = ("guaranteed", "guarantee", "always", "never", "definitely", "certainly", "100%", "instant", "instantly", "immediately", "no exceptions", "promise", "promised", "assured", "without fail")
TAGS = ("unsupported_claim", "missed_key_fact", "policy_violation", "retrieval_miss", "overconfident_tone", "irrelevant_answer")


def has_marker(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)\b(" + "|".join(MARKERS) + r")\b"), F.lit(False))


def severity(risk_level: Column, risk: dict) -> Column:
    """Severity of a risk level; the highest for an unknown one."""
    known = F
    for level, value in risk["levels"].items():
        known = known.when(risk_level == level, value)
    return known.otherwise(risk["unknown_severity"])


def failure_tags(scores: DataFrame, queries: DataFrame, answers: DataFrame, reviews: DataFrame, config: dict) -> DataFrame:
    """query_id, variant, tags (in the order of TAGS) of each score.

    queries: query_id, risk_level. answers: query_id, variant, answer; one that is missing counts as
    empty. reviews: query_id, variant, overclaim; one that is missing claims nothing too much."""
    rows = scores.join(queries.select("query_id", "risk_level"), "query_id")
    rows = rows.join(answers.select("query_id", "variant", "answer"), ["query_id", "variant"], "left").join(reviews.select("query_id", "variant", "overclaim"), ["query_id", "variant"], "left")
    broken, weak = ~F.col("must_not_claim_pass"), F.col("grounding_score") < config["grounding"]["low_grounding_threshold"]
    grave = severity(F.col("risk_level"), config["risk"]) >= config["gates"]["disqualify_must_not_claim_at_severity"]
    holds = {
        "unsupported_claim": broken | F.array_contains("risk_flags", "unsupported_numeric") | F.coalesce("overclaim", F.lit(False)),
        "missed_key_fact": ~F.col("must_include_pass"),
        "policy_violation": broken & grave,
        "retrieval_miss": ~F.col("retrieval_hit"),
        "overconfident_tone": has_marker(F.coalesce("answer", F.lit(""))) & (broken | weak),
        "irrelevant_answer": ~F.col("retrieval_hit") & weak,
    }
    return rows.select("query_id", "variant", F.array_compact(F.array(*(F.when(holds[tag], tag) for tag in TAGS))).alias("tags"))
