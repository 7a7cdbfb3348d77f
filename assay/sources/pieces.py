"""Large text files in many parts: numbered lines, and JSON arrays cut at the commas between their elements.

A scan's split knows where it begins in its file and tasks read splits in order, so a table of counts by split
gives every line its number with no shuffle of the lines. For arrays the separator is the comma: a piece that ends at one
says how many quotes and brackets it has, and sums over the pieces before tell whether its comma stands between two elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.operators.kept import kept

_ESCAPED, _STRING, _TAIL = r"(?s)\\.", r'(?s)"[^"]*("|$)', r'(?s)^[^"]*("|$)'


def _splits(rows: DataFrame, **totals: Column) -> DataFrame:
    """file, split, first and totals of each split, with `n` rows. One row for each split of the scan."""
    return rows.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), *(v.alias(k) for k, v in totals.items()))


def _before(c: Column) -> Column:
    """Sum over the splits before: as many rows as the scan has splits, whatever their size."""
    return F.coalesce(F.sum(c).over(Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _scan(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """value, file, split (its first byte), at (grows within a split)."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1, over all files of the path by name) and value of each line; a carriage return at its end is no part of it."""
    rows = _scan(spark, path, "\n")
    splits = _splits(rows).select("file", "split", "first", _before(F.col("n")).alias("lines"))
    return rows.join(F.broadcast(splits), ["file", "split"]).select((F.col("lines") + F.col("at") - F.col("first") + 1).alias("line"), F.regexp_replace("value", r"\r$", "").alias("value"))


def _depth(text: Column) -> Column:
    count = lambda of: F.length(text) - F.length(F.translate(text, of, ""))
    return count("[{") - count("]}")


def _measured(rows: DataFrame) -> DataFrame:
    """rows with quotes (of either kind: a backslash takes the next character along), and the brackets opened if the piece begins outside or within a string."""
    bare = F.regexp_replace("value", _ESCAPED, "")
    rows = rows.withColumn("bare", bare)
    inner = F.regexp_replace(F.regexp_replace("bare", _TAIL, ""), _STRING, "")
    return rows.withColumns({"quotes": F.length("bare") - F.length(F.translate("bare", '"', "")), "out": _depth(F.regexp_replace("bare", _STRING, "")), "in": _depth(inner)}).drop("bare")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, split, at, value, and sums up to here over the split's pieces: q (quotes), d0 and d1 (brackets, if the split begins outside or within a string)."""
    upto = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _measured(_scan(spark, path, ",")).withColumn("q", F.sum("quotes").over(upto))
    odd = (F.col("q") - F.col("quotes")) % 2 == 1
    rows = rows.withColumns({"d0": F.sum(F.when(odd, F.col("in")).otherwise(F.col("out"))).over(upto), "d1": F.sum(F.when(odd, F.col("out")).otherwise(F.col("in"))).over(upto)})
    return rows.select("file", "split", "at", "value", "q", "d0", "d1")


def _placed(pieces: DataFrame) -> DataFrame:
    """pieces with nth (of the split), string and depth (where the piece ends), final, and top: whether a comma between two elements ends it."""
    last = lambda c: F.max_by(c, "at")
    splits = _splits(pieces, q=last("q"), d0=last("d0"), d1=last("d1"), end=F.max("at"))
    splits = splits.withColumn("within", _before(F.col("q")) % 2 == 1)
    order = Window.orderBy("file", "split")
    splits = splits.select("file", "split", "within", "end", _before(F.when(F.col("within"), F.col("d1")).otherwise(F.col("d0"))).alias("start"), F.row_number().over(order).alias("nth"), F.lead("split").over(order).isNull().alias("last"))
    # One row for each split: else the pieces would be shuffled to meet them.
    rows = pieces.join(F.broadcast(splits), ["file", "split"])
    string = (F.col("q") % 2 == 1) != F.col("within")
    depth = F.col("start") + F.when(F.col("within"), F.col("d1")).otherwise(F.col("d0"))
    final = F.col("last") & (F.col("at") == F.col("end"))
    return rows.select("nth", "at", "value", string.alias("string"), depth.alias("depth"), final.alias("final"), (~string & (depth == 1) & ~final).alias("top"))


def strictly(text: Column) -> Column:
    """The JSON value of the whole text as VARIANT, or null. A parser stops after the first value, so the text is put between two
    fields: what stands after its value would hide the second one, whose name is the text's digest, or add another."""
    mark = F.md5(text.cast("binary"))
    both = F.concat(F.lit('{"v":'), text, F.lit(',"'), mark, F.lit('":0}'))
    keys = F.json_object_keys(both)
    whole = (F.size(keys) == 2) & F.array_contains(keys, mark)
    return F.when(whole, F.try_variant_get(F.try_parse_json(both), "$.v", "variant"))


#: Opening brackets and what shuts them.
_SHUT = {"[": "]", "{": "}"}


def array_elements(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(idx, record, raw of each element of a JSON array file; "" or what is wrong: INVALID_JSON or NOT_AN_ARRAY, without rows then).

    The file is read in splits; no row holds more than one element, and only the first and last sign and some counts come to the
    driver. An object at the top is checked field by field."""
    pieces = kept(_pieces(spark, path), "array-pieces")
    placed = _placed(pieces)
    sign = lambda pattern: F.regexp_extract("value", pattern, 1)
    ends = placed.agg(F.min_by(sign(r"^[ \t\r\n]*([^ \t\r\n])"), F.struct("nth", "at")).alias("open"), F.max(F.when(F.col("final"), F.struct(sign(r"([^ \t\r\n])[ \t\r\n]*$").alias("close"), "depth", "string"))).alias("end")).first()
    none = spark.createDataFrame([], "idx int, record variant, raw string")
    # One split's table is small, and so are its sums; the pieces meet them by the number of their split.
    if not ends.open or ends.end.depth or ends.end.string or ends.end.close != _SHUT.get(ends.open, ends.end.close):
        return none, "INVALID_JSON"
    here = Window.partitionBy("nth").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("own", F.coalesce(F.sum(F.col("top").cast("int")).over(here), F.lit(0)))
    tops = placed.groupBy("nth").agg(F.sum(F.col("top").cast("int")).alias("n")).select("nth", F.coalesce(F.sum("n").over(Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("tops"))
    rows = own.join(F.broadcast(tops), "nth").withColumn("idx", (F.col("tops") + F.col("own")).cast("int"))
    rows = rows.groupBy("idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "at", "value"))), lambda p: p["value"]), ",").alias("raw"), F.bool_or("final").alias("final"))
    raw = F.col("raw")
    if ends.open in _SHUT:
        raw = F.when(F.col("idx") == 0, F.regexp_replace(raw, r"^[ \t\r\n]*[\[{]", "")).otherwise(raw)
        raw = F.when(F.col("final"), F.regexp_replace(raw, r"[\]}][ \t\r\n]*$", "")).otherwise(raw)
    rows = rows.select("idx", F.regexp_replace(raw, r"^[ \t\r\n]+|[ \t\r\n]+$", "").alias("raw"))
    text = F.concat(F.lit("{"), "raw", F.lit("}")) if ends.open == "{" else F.col("raw")
    # The text is written once; its parsed form, which is as long, is made again where it is read.
    record = F.when(F.col("raw") != "", strictly(text))
    rows = kept(rows.select("idx", "raw", record.isNull().alias("broken")), "array-records")
    seen = rows.agg(F.count_if("broken").alias("bad"), F.count(F.lit(1)).alias("n"), F.max("raw").alias("most")).first()
    rows = rows.select("idx", record.alias("record"), "raw")
    empty = ends.open in _SHUT and seen.n == 1 and seen.most == ""
    if seen.bad and not empty:
        return none, "INVALID_JSON"
    if ends.open != "[":
        return none, "NOT_AN_ARRAY"
    return none if empty else rows, ""
