"""Checks of inputs and artifacts, each a table of issues: code, location, message, severity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR, WARNING = "ERROR", "WARNING"


def issues(rows: DataFrame, code: str, location: Column, message: Column, severity: str = ERROR) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), location.alias("location"), message.alias("message"), F.lit(severity).alias("severity"))


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def dangling_doc_ids(queries: DataFrame, kb: DataFrame) -> DataFrame:
    """One issue for each expected document that the knowledge base lacks."""
    rows = queries.select("query_id", F.explode("expected_doc_ids").alias("doc_id")).join(kb.select("doc_id").distinct(), "doc_id", "left_anti")
    return issues(rows, "DANGLING_DOC_ID", F.col("query_id"), F.concat(F.lit("unknown doc_id "), F.col("doc_id")))


def dangling_query_ids(answers: DataFrame, queries: DataFrame) -> DataFrame:
    rows = answers.select("query_id").distinct().join(queries.select("query_id"), "query_id", "left_anti")
    return issues(rows, "DANGLING_QUERY_ID", F.col("query_id"), F.lit("answers to an unknown query"))


def missing_answers(queries: DataFrame, answers: DataFrame) -> DataFrame:
    rows = queries.select("query_id").join(answers.select("query_id"), "query_id", "left_anti")
    return issues(rows, "MISSING_ANSWERS", F.col("query_id"), F.lit("no answers"), WARNING)


def inconsistent_variants(answers: DataFrame) -> DataFrame:
    """One warning for each variant that some queries have and this one lacks. answers: query_id, variant.

    The list of all variants is a short array by nature; each query's own set is subtracted from it, so
    no product of queries and variants is formed."""
    every = answers.agg(F.collect_set("variant").alias("every"))  # one row
    own = answers.groupBy("query_id").agg(F.collect_set("variant").alias("own")).join(F.broadcast(every))
    rows = own.select("query_id", F.explode(F.array_except("every", "own")).alias("variant"))
    return issues(rows, "INCONSISTENT_VARIANTS", F.col("query_id"), F.concat(F.lit("lacks variant "), F.col("variant")), WARNING)


def first_seen_variants(answers: DataFrame) -> DataFrame:
    """variant, v_ord (position of its first answer) of rows with a_ord and v_pos."""
    return answers.groupBy("variant").agg(F.min(F.struct("a_ord", "v_pos")).alias("v_ord"))


def duplicate_ids(rows: DataFrame, key: str, order: str) -> DataFrame:
    """All rows of a key but the first by order, with the first's place: pre-aggregated, then an equi-join."""
    first = rows.groupBy(key).agg(F.min(order).alias("first_seen"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(first, key).where(F.col(order) > F.col("first_seen")).select(key, order, "first_seen")


def unprocessed_answers(answers: DataFrame, scores: DataFrame) -> DataFrame:
    rows = answers.select("query_id", "variant").join(scores.select("query_id", "variant"), ["query_id", "variant"], "left_anti")
    return issues(rows, "UNPROCESSED_ANSWER", F.concat("query_id", F.lit("/"), "variant"), F.lit("no score"))


def retrieval_counts(queries: DataFrame, retrieval: DataFrame, kb: DataFrame, top_k: int) -> DataFrame:
    """Queries without passages, or with another number than the lesser of top_k and the size of the knowledge base."""
    wanted = kb.limit(top_k).count()
    rows = queries.select("query_id").join(retrieval.select("query_id", F.size("retrieved").alias("n")), "query_id", "left")
    none = issues(rows.where("n IS NULL"), "MISSING_RETRIEVAL", F.col("query_id"), F.lit("no passages"))
    wrong = issues(rows.where(F.col("n") != wanted), "WRONG_RETRIEVAL_COUNT", F.col("query_id"), F.concat(F.lit("passages: "), F.col("n").cast("string"), F.lit(f", wanted {wanted}")))
    return none.unionByName(wrong)


def input_issues(kb: DataFrame, queries: DataFrame, answers: DataFrame) -> DataFrame:
    """All referential issues, warnings too, whether or not there are errors. answers: query_id, variant."""
    return union([dangling_doc_ids(queries, kb), dangling_query_ids(answers, queries), missing_answers(queries, answers), inconsistent_variants(answers)])


#: Parts of a table whose fingerprints are compared; those that agree aren't looked at row by row.
PARTS = 4096


def row_texts(table: DataFrame) -> DataFrame:
    """row (JSON with the columns by name), part, and two hashes of it."""
    text = table.select(F.to_json(F.struct(*sorted(table.columns))).alias("row"))
    return text.select("row", F.xxhash64("row").alias("h1"), F.xxhash64(F.lit("second"), "row").alias("h2")).withColumn("part", F.pmod("h1", F.lit(PARTS)).cast("int"))


def fingerprints(rows: DataFrame) -> DataFrame:
    """part, n, a, b of row_texts(): how many rows a part has and the sums of both hashes, whatever their order. PARTS rows at most."""
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), total("h1").alias("a"), total("h2").alias("b"))


def differing_parts(a: DataFrame, b: DataFrame) -> DataFrame:
    """part of the fingerprints that differ, or that one side lacks."""
    same = F.col("x.n").eqNullSafe(F.col("y.n")) & F.col("x.a").eqNullSafe(F.col("y.a")) & F.col("x.b").eqNullSafe(F.col("y.b"))
    return fingerprints(a).alias("x").join(fingerprints(b).alias("y"), "part", "full").where(~same).select("part")


def differences(stored: DataFrame, computed: DataFrame, code: str = "NOT_REPRODUCIBLE") -> DataFrame:
    """Rows that only one of two tables has, as JSON; both with repeats. Null fields count as absent.

    Fingerprints of the parts combine before they shuffle; only rows of parts whose fingerprints differ are compared, so
    two equal tables cost a scan each."""
    a, b = row_texts(stored), row_texts(computed)
    bad = F.broadcast(differing_parts(a, b))  # PARTS rows at most
    a, b = (x.join(bad, "part", "left_semi").select("row") for x in (a, b))
    gone, new = a.exceptAll(b), b.exceptAll(a)
    return issues(gone, code, F.lit("stored"), F.col("row")).unionByName(issues(new, code, F.lit("computed"), F.col("row")))
