"""How far an answer is borne out by its evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.text import content_terms, let, stems, without_stopwords

# Fixed value: what counts as a number.
NUMBER = r"(\d[\d,]*(?:\.\d+)?%?)"


def rounded(x: Column, digits: int, shift: float = 0.0) -> Column:
    """Half up; shift moves values off ties, so that engines with other binary rounding agree."""
    return F.round(x + shift if shift else x, digits)


def evidence_text(retrieved: Column) -> Column:
    """Titles and texts of the passages, by rank."""
    return F.array_join(F.transform(retrieved, lambda p: F.concat(F.coalesce(p["title"], F.lit("")), F.lit(" "), F.coalesce(p["text"], F.lit("")))), " ")


def precision(answer_terms: Column, evidence_terms: Column) -> Column:
    """Share of the answer's content terms, repeats counted, that the evidence holds; 0 for none."""
    held = lambda words: let(F.array_intersect(words, evidence_terms), lambda both: F.size(F.filter(words, lambda t: F.array_contains(both, t))))
    return let(answer_terms, lambda words: F.when(F.size(words) > 0, held(words) / F.size(words)).otherwise(0.0))


def _pairs(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b)))


def evidence_pairs(evidence: Column) -> Column:
    """Neighbouring words of the evidence, cut at single spaces: what has_quote() looks up before it searches the text."""
    return _pairs(F.split(evidence, " "))


def has_quote(answer_tokens: Column, evidence: Column, pairs: Column, least: int) -> Column:
    """Some `least` neighbouring tokens of the answer, joined by spaces, are a substring of the evidence.

    evidence is lower-cased already, pairs are its evidence_pairs(). The inner tokens of such a quote stand
    between spaces, so where there are two of them they are one of the pairs; only those are searched for."""
    starts = F.sequence(F.lit(1), F.size(answer_tokens) - least + 1)
    quote = lambda i: F.contains(evidence, F.array_join(F.slice(answer_tokens, i, least), " "))
    if least >= 4:
        inner = lambda both: F.filter(starts, lambda i: F.array_contains(both, F.array_join(F.slice(answer_tokens, i + 1, 2), " ")))
        found = let(F.array_intersect(_pairs(answer_tokens), pairs), lambda both: F.when(F.size(both) > 0, F.exists(inner(both), quote)).otherwise(False))
        return F.when(F.size(answer_tokens) >= least, found).otherwise(False)
    return F.when(F.size(answer_tokens) >= least, F.exists(starts, quote)).otherwise(False)


def unsupported_numbers(answer: Column, evidence: Column) -> Column:
    """Distinct numbers of the answer that aren't substrings of the evidence, which is lower-cased already, sorted."""
    numbers = F.regexp_extract_all(answer, F.lit(NUMBER), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: ~F.contains(evidence, n))))


def with_grounding(rows: DataFrame, config: dict, shift: float = 0.0) -> DataFrame:
    """rows with precision, quote, unsupported and grounding_score: weighted precision, a bonus for a quote, a
    penalty for unsupported numbers, within 0 and 1.

    rows: answer, words (its tokens), evidence (lower-cased), evidence_terms, evidence_pairs; what is of the
    evidence is made by with_evidence(), once for each query and not for each answer."""
    share = precision(stems(without_stopwords(F.col("words"))), F.col("evidence_terms"))
    rows = rows.withColumns({"share": share, "quote": has_quote(F.col("words"), F.col("evidence"), F.col("evidence_pairs"), config["min_quote_span"]), "unsupported": unsupported_numbers(F.col("answer"), F.col("evidence"))})
    raw = config["precision_weight"] * F.col("share") + F.when(F.col("quote"), config["quote_bonus"]).otherwise(0.0) - F.when(F.size("unsupported") > 0, config["numeric_penalty"]).otherwise(0.0)
    score = rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), config["score_precision"], shift)
    return rows.withColumns({"precision": rounded(F.col("share"), 4, shift), "grounding_score": score}).drop("share")


def with_evidence(rows: DataFrame, retrieved: str = "retrieved") -> DataFrame:
    """rows with evidence, evidence_terms and evidence_pairs of the retrieved passages."""
    rows = rows.withColumn("evidence", F.lower(evidence_text(F.col(retrieved))))
    return rows.withColumns({"evidence_terms": F.array_distinct(content_terms(F.col("evidence"))), "evidence_pairs": evidence_pairs(F.col("evidence"))})
