"""Input files: JSON arrays read with positions, every problem an issue, good records kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators.kept import kept
from assay.operators.validate import ERROR, duplicate_ids, input_issues, issues, union
from assay.sources.pieces import array_elements, strictly

_STRIP = r"^\s+|\s+$"


#: A file of so many bytes may be parsed as one row, which costs fewer jobs; the result is the same.
WHOLE_BYTES = 1 << 20
#: Issues that an error names; the table of issues has all of them.
MOST_SHOWN = 1000


class InputError(ValueError):
    """Inputs with errors; issues has the first MOST_SHOWN of them."""

    def __init__(self, rows: list) -> None:
        super().__init__("\n".join(f"[{r.severity}] {r.code} {r.location}: {r.message}" for r in rows))
        self.issues = rows


@dataclass
class Inputs:
    """kb, queries (with q_ord) and answers (long, with a_ord and v_pos), and all issues found."""

    kb: DataFrame
    queries: DataFrame
    answers: DataFrame
    issues: DataFrame


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any store that Spark reads has this path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def file_bytes(spark: SparkSession, path: str) -> int:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, _STRIP, "")


def read_array(spark: SparkSession, path: str, whole_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(idx, record, a variant, and raw, its JSON text, of each element; issues of the file). Nothing is read of a file that can't be used.

    A file of more than whole_bytes (WHOLE_BYTES) is cut between its elements, split by split, so neither a row nor a task holds the whole of it."""
    if not exists(spark, path):
        lost = spark.createDataFrame([(path,)], "p string")
        return spark.sql("SELECT 0 AS idx, parse_json('null') AS record, '' AS raw WHERE false"), issues(lost, "FILE_NOT_FOUND", F.col("p"), F.lit("no such file"))
    if file_bytes(spark, path) <= (WHOLE_BYTES if whole_bytes is None else whole_bytes):
        return _small_array(spark, path)
    rows, wrong = array_elements(spark, path)
    at = spark.createDataFrame([(path,)] if wrong else [], "p string")
    return rows, issues(at, wrong, F.col("p"), F.lit("not JSON" if wrong == "INVALID_JSON" else "the top level is no array"))


def _small_array(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """read_array() of a file that may be one row."""
    whole = spark.read.text(path, wholetext=True).select("value", strictly(F.col("value")).alias("v")).withColumn("kind", F.schema_of_variant("v"))
    bad = issues(whole.where("v IS NULL"), "INVALID_JSON", F.lit(path), F.lit("not JSON")).unionByName(issues(whole.where("kind NOT LIKE 'ARRAY%'"), "NOT_AN_ARRAY", F.lit(path), F.lit("the top level is no array")))
    both = F.arrays_zip(F.variant_get("v", "$", "array<variant>").alias("record"), F.from_json("value", "array<string>").alias("raw"))
    return whole.where("kind LIKE 'ARRAY%'").select(F.posexplode(both).alias("idx", "e")).select("idx", "e.record", "e.raw"), bad


def text_field(name: str, missing: bool = True) -> tuple[Column, Column]:
    """A string field without outer white space, and whether it is wrong: no string, or blank."""
    value = F.try_variant_get("record", f"$.{name}", "variant")
    text = stripped(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get("record", f"$.{name}", "string")))
    return text, (text.isNull() | (text == "")) if missing else text.isNull()


def _strings(name: str) -> tuple[Column, Column]:
    """A list of strings without blank ones, empty if absent, and whether it is wrong."""
    kind = F.schema_of_variant(F.try_variant_get("record", f"$.{name}", "variant"))
    ok = kind.isNull() | kind.isin("ARRAY<STRING>", "ARRAY<VOID>")
    value = F.coalesce(F.when(ok, F.try_variant_get("record", f"$.{name}", "array<string>")), F.array().cast("array<string>"))
    return F.filter(F.transform(value, stripped), lambda x: x.isNotNull() & (x != "")), ~ok


def typed_records(rows: DataFrame, path: str, key: str, fields: dict[str, tuple[Column, Column]]) -> tuple[DataFrame, DataFrame]:
    """(good records with idx, first of each key; issues): a bad record costs itself, never its neighbours."""
    place = F.concat(F.lit(f"{path}["), F.col("idx").cast("string"), F.lit("]"))
    kind = F.coalesce(F.schema_of_variant("record"), F.lit("VOID"))
    strange = issues(rows.where(~kind.startswith("OBJECT")), "NOT_AN_OBJECT", place, F.lit("record is no object"))
    parsed = rows.where(kind.startswith("OBJECT")).select("idx", *(v.alias(n) for n, (v, _) in fields.items()), F.array_compact(F.array(*(F.when(bad, n) for n, (_, bad) in fields.items()))).alias("_bad"))
    parsed = kept(parsed, "parsed-records")
    wrong = issues(parsed.withColumn("f", F.explode("_bad")), "SCHEMA_INVALID", F.concat(place, F.lit("."), F.col("f")), F.lit("missing, blank or of another type"))
    good = parsed.where(F.size("_bad") == 0).drop("_bad")
    again = kept(duplicate_ids(good, key, "idx"), "repeated-ids")
    twice = issues(again, "DUPLICATE_ID", F.concat(place, F.lit(f".{key}")), F.concat(F.lit("first seen at index "), F.col("first_seen").cast("string")))
    return good.join(again.select("idx"), "idx", "left_anti"), union([strange, wrong, twice])


def load_inputs(spark: SparkSession, kb_path: str, queries_path: str, answers_path: str, strict: bool = True) -> Inputs:
    """The three input files as tables. With strict, errors raise InputError with all issues; the table of issues has warnings in any case."""
    raw, found = {}, []
    for name, path in (("kb", kb_path), ("queries", queries_path), ("answers", answers_path)):
        raw[name], bad = read_array(spark, path)
        found.append(bad)
    kb, bad = typed_records(raw["kb"], kb_path, "doc_id", {"doc_id": text_field("doc_id"), "title": text_field("title", False), "text": text_field("text")})
    found.append(bad)
    fields = {n: text_field(n) for n in ("query_id", "user_question", "risk_level")} | {n: _strings(n) for n in ("expected_doc_ids", "must_include_any", "must_not_claim")}
    queries, bad = typed_records(raw["queries"], queries_path, "query_id", fields)
    found.append(bad)
    given = F.from_json(F.to_json("record"), "answers map<string,variant>")["answers"]
    values = F.map_values(F.transform_values(given, lambda _, v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))))
    ok = F.coalesce((F.size(given) > 0) & F.forall(F.map_keys(given), lambda k: stripped(k) != "") & F.forall(values, lambda t: t == "STRING"), F.lit(False))
    answers, bad = typed_records(raw["answers"], answers_path, "query_id", {"query_id": text_field("query_id"), "answers": (F.when(ok, F.from_json("raw", "answers map<string,string>")["answers"]), ~ok)})
    found.append(bad)
    for name, path, table in (("KB", kb_path, kb), ("QUERIES", queries_path, queries), ("ANSWERS", answers_path, answers)):
        if not table.limit(1).count():
            found.append(issues(spark.createDataFrame([(path,)], "p string"), f"EMPTY_{name}", F.col("p"), F.lit("no valid record")))
    long = answers.select(F.col("idx").alias("a_ord"), "query_id", F.posexplode("answers").alias("v_pos", "variant", "answer")).withColumns({"variant": stripped(F.col("variant")), "answer": stripped(F.col("answer"))})
    queries = queries.withColumnRenamed("idx", "q_ord")
    every = kept(union([*found, input_issues(kb, queries, long)]), "input-issues")
    if strict and every.where(F.col("severity") == ERROR).limit(1).count():
        raise InputError(every.orderBy("location", "code").limit(MOST_SHOWN).collect())
    return Inputs(kb.drop("idx"), queries, long, every)
