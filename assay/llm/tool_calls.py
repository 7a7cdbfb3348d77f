"""Chat formatting: tool-call linking with DataFrame operations only.

Calls and results meet on their identifiers by hash join, calls are ordered by the longest chain of calls
whose results they use, arguments are checked against schemas, and each call is written as canonical JSON
(keys sorted, no spaces)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.text import let
from assay.llm._state import drop, keep
from assay.sources.pieces import strictly

#: Types of a schema, and how the type of a parsed JSON value begins.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DECIMAL|DOUBLE)", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}
SCHEMAS = "name string, fields array<struct<path:string,field:string,parent:string,key:string,type:string,required:boolean,allowed:array<string>>>"

#: Digits that a double keeps: a longer number loses trailing zeros only.
DIGITS = 15


def _number(n: Column) -> Column:
    """A JSON number that has a fraction or an exponent, as all spellings of its value are written."""
    value = n.cast("double")
    plain = F.when((value == F.floor(value)) & (F.abs(value) < 10.0**DIGITS), F.floor(value).cast("string")).otherwise(value.cast("string"))
    return F.when(F.length(F.regexp_replace(n, r"[^0-9]|[eE].*", "")) > DIGITS + 2, F.regexp_replace(n, r"(\.[0-9]*?)0+$", "$1")).otherwise(plain)


def canonical(text: Column) -> Column:
    """JSON text as to_json() writes it, with one spelling for equal numbers (1e2 and 100.0 are 100). What is in strings stays.

    Escaped backslashes and quotes are put aside, so that every second part between quotes is outside of strings."""
    parts = F.split(F.replace(F.replace(text, F.lit("\\\\"), F.lit("\u0001")), F.lit('\\"'), F.lit("\u0002")), '"')
    fix = lambda t: F.when(F.regexp(t, F.lit(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$")) & F.regexp(t, F.lit("[.eE]")), _number(t)).otherwise(t)
    outside = lambda x: F.when(F.regexp(x, F.lit("[0-9][.eE]")), F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"([^\[\]{}:,]+|[\[\]{}:,])"), F.lit(1)), fix), "")).otherwise(x)
    joined = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, outside(x)).otherwise(x)), '"')
    return F.replace(F.replace(joined, F.lit("\u0002"), F.lit('\\"')), F.lit("\u0001"), F.lit("\\\\"))


def _quotes(text: Column) -> Column:
    """Quotes of a JSON text that aren't escaped."""
    bare = F.regexp_replace(text, r"(?s)\\.", "")
    return F.length(bare) - F.length(F.translate(bare, '"', ""))


def _finite(text: Column) -> Column:
    """The JSON value of a text, or null; a number beyond a double's range would come back as a string, which two more quotes tell."""
    parsed = strictly(text)
    return F.when(_quotes(F.to_json(parsed)) == _quotes(text), parsed)


def schema_table(spark: SparkSession, tools: dict[str, dict]) -> DataFrame:
    """name and fields of {tool: {field: (type, required) or spec}}.

    A spec is a dictionary: type, required (false), enum (allowed values), items (type of a list's
    elements), fields (specs of an object's own fields, which are checked where the object is there)."""

    def flat(fields: dict, above: str = "", parent: str = "$") -> list[tuple]:
        out = []
        for name, spec in sorted(fields.items()):
            spec = {"type": spec[0], "required": spec[1]} if isinstance(spec, tuple) else spec
            field, path = f"{above}.{name}" if above else name, f"{parent}['{name}']"
            kind = TYPES[spec["type"]] + (f"<({TYPES[spec['items']]}|VOID|VARIANT)" if "items" in spec else "")
            allowed = [json.dumps(v) for v in spec["enum"]] if "enum" in spec else None
            out.append((path, field, parent, name, kind, bool(spec.get("required")), allowed))
            out += flat(spec.get("fields", {}), field, path)
        return out

    rows = spark.createDataFrame([(name, flat(fields)) for name, fields in sorted(tools.items())], SCHEMAS)
    # Allowed values are compared as they are written here: by one serialiser, with one spelling of numbers.
    same = lambda f: F.transform(f["allowed"], lambda v: canonical(F.to_json(F.parse_json(v))))
    return rows.withColumn("fields", F.transform("fields", lambda f: f.withField("allowed", same(f))))


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """conv_id, call_id, level: 0 for a call that uses no known result, else one more than the highest of the calls it uses; null on a cycle or behind one.

    calls: conv_id, call_id. edges: conv_id, call_id, after, between known calls. Where no call uses more
    than one result, by pointer doubling, in as many rounds as the longest chain's length has bits; else the
    calls whose predecessors are all ordered are ordered round by round, and those of round n have level n."""
    many = edges.groupBy("conv_id", "call_id").count().where("count > 1").limit(1).count()
    return _rounds(calls, edges) if many else _doubled(calls, edges)


def _doubled(calls: DataFrame, edges: DataFrame) -> DataFrame:
    start = calls.select("conv_id", "call_id").join(edges, ["conv_id", "call_id"], "left")
    now = keep(start.select("conv_id", "call_id", F.col("after").alias("at"), F.col("after").isNotNull().cast("long").alias("level")), "call-levels")
    most = now.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
    for _ in range(most.bit_length()):
        if not now.where("at IS NOT NULL").limit(1).count():
            break
        to = now.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), F.col("at").alias("_at"), F.col("level").alias("_level"))
        both = now.join(to, (F.col("conv_id") == F.col("_c")) & (F.col("at") == F.col("_i")), "left")
        new = keep(both.select("conv_id", "call_id", F.col("_at").alias("at"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level")), "call-levels")
        drop(now)
        now = new
    return now.select("conv_id", "call_id", F.when(F.col("at").isNull(), F.col("level")).alias("level"))


def _rounds(calls: DataFrame, edges: DataFrame) -> DataFrame:
    own = ["conv_id", "call_id"]
    waits = keep(calls.select(*own).join(edges.groupBy(own).agg(F.count(F.lit(1)).alias("left")), own, "left").withColumn("left", F.coalesce("left", F.lit(0))), "call-waits")
    done, level = [], 0
    while True:
        ready = keep(waits.where(F.col("left") == 0).select(*own, F.lit(level).cast("long").alias("level")), "call-ready")
        done.append(ready)
        met = edges.join(ready.select("conv_id", F.col("call_id").alias("after")), ["conv_id", "after"]).groupBy(own).agg(F.count(F.lit(1)).alias("met"))
        rest = waits.where(F.col("left") > 0).join(met, own, "left")
        new = keep(rest.select(*own, (F.col("left") - F.coalesce("met", F.lit(0))).alias("left")), "call-waits")
        drop(waits)
        waits, level = new, level + 1
        if not waits.where(F.col("left") == 0).limit(1).count():
            break
    out = waits.select(*own, F.lit(None).cast("long").alias("level"))
    for table in done:
        out = out.unionByName(table)
    return out


def argument_errors(arguments: str, fields: str) -> Column:
    """Sorted errors of a JSON string against an array of fields, as schema_table() gives them.

    Text that isn't one JSON value and nothing else is no object, as are repeated keys; a number beyond a double's range is an error.
    Numbers with a fraction or an exponent are no integers, however they are spelt. Keys are compared as they are: a dot doesn't lead into an object.
    An object without stated fields may have any; in others, at any depth, unknown keys are errors."""
    return let(strictly(F.col(arguments)), lambda parsed: _errors(parsed, arguments, fields))


def _errors(parsed: Column, arguments: str, fields: str) -> Column:
    """argument_errors() of the parsed arguments, which many lambdas refer to."""
    value = lambda path: F.try_variant_get(parsed, path, "variant")
    kind = lambda path: F.coalesce(F.schema_of_variant(value(path)), F.lit("VOID"))
    # An inner field counts only where the object around it is there.
    there = lambda path: F.startswith(kind(path), F.lit("OBJECT"))
    said = lambda what, keep_: F.transform(F.filter(F.col(fields), keep_), lambda f: F.concat(F.lit(what), f["field"]))
    missing = said("missing ", lambda f: f["required"] & there(f["parent"]) & (kind(f["path"]) == "VOID"))
    wrong = said("type of ", lambda f: (kind(f["path"]) != "VOID") & ~F.regexp(kind(f["path"]), F.concat(F.lit("^"), f["type"])))
    other = said("value of ", lambda f: f["allowed"].isNotNull() & (kind(f["path"]) != "VOID") & ~F.array_contains(f["allowed"], canonical(F.to_json(value(f["path"])))))
    around = F.array_union(F.array(F.lit("$")), F.transform(F.col(fields), lambda f: f["parent"]))
    name = lambda path: F.coalesce(F.concat(F.get(F.filter(F.col(fields), lambda f: f["path"] == path), 0)["field"], F.lit(".")), F.lit(""))
    known = lambda path: F.transform(F.filter(F.col(fields), lambda f: f["parent"] == path), lambda f: f["key"])
    more = lambda path: F.transform(F.array_except(F.json_object_keys(F.to_json(value(path))), known(path)), lambda k: F.concat(F.lit("unknown "), name(path), k))
    extra = F.flatten(F.transform(F.filter(around, there), more))
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    large = F.when(_quotes(F.to_json(parsed)) != _quotes(F.col(arguments)), F.array(F.lit("number out of range"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.col(fields).isNull(), F.array(F.lit("unknown tool"))).when(~is_object, F.array(F.lit("not an object"))).otherwise(F.array_sort(F.concat(missing, wrong, other, extra, large)))


def orphan_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """conv_id, call_id, turn, content of results that belong to no call, those without a conversation or id too."""
    known = calls.select("conv_id", "call_id").distinct()
    return results.select("conv_id", "call_id", "turn", "content").join(known, ["conv_id", "call_id"], "left_anti")


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, call_id, turn, name, level, errors, valid, n_results, record of each call.

    calls: conv_id, call_id, turn, name, arguments (JSON text), after (array of the ids of calls of the same
    conversation whose results it uses; null and null ids count as none, repeated ones once). results:
    conv_id, call_id, turn, content. Of calls of one conversation and id the first by turn, name and
    arguments counts; of its results the first by turn and content is linked, n_results counts all; those of
    no call are orphan_results(). Calls without conversation or id are left out; an unknown id in `after`
    adds an error and no level. Sorting by level, turn and call_id is a topological order of each
    conversation; on a cycle and behind it level is null and an error says so. Null or empty arguments are
    no object, and arguments that aren't one JSON value with numbers in range are null in the record; equal numbers have one spelling in it; other columns are left out; empty tables give an empty one."""
    own = ["conv_id", "call_id"]
    after = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("after", F.array().cast("array<string>")))))
    named = calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).withColumn("after", after)
    first = named.groupBy(own).agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c"))
    one = keep(first.select(*own, "c.turn", "c.name", "c.arguments", "c.after"), "calls")
    found = results.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).groupBy(own).agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    uses = one.select(*own, F.explode("after").alias("after")).join(one.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known")), ["conv_id", "after"], "left")
    uses = keep(uses, "call-uses")
    lost = uses.where("known IS NULL").select(*own).distinct().withColumn("lost", F.lit(True))
    order = levels(one, uses.where("known").select(*own, "after"))
    all_of = one.join(order, own).join(found, own, "left").join(lost, own, "left").join(schemas, "name", "left")
    none = F.array().cast("array<string>")
    loose = F.when(F.col("lost"), F.array(F.lit("unknown after"))).otherwise(none)
    cycle = F.when(F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(none)
    errors = F.concat(argument_errors("arguments", "fields"), cycle, loose)
    record = F.struct(F.col("after"), _finite(F.col("arguments")).alias("arguments"), F.col("call_id"), F.col("conv_id"), F.col("level"), F.col("name"), F.col("r.content").alias("result"), F.col("turn"))
    out = all_of.select(*own, "turn", "name", "level", errors.alias("errors"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), canonical(F.to_json(record, {"ignoreNullFields": "false"})).alias("record"))
    return out.withColumn("valid", F.size("errors") == 0)


#: Tools of the calls that op2 makes of conversations.
TOOLS = {"answer": {"text": ("string", True), "turn": ("integer", True), "words": ("integer", True)}, "lookup": {"text": ("string", True), "words": ("integer", False)}}


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assistant turns as calls, each using the result of the one two turns before; the user turn that follows is its result."""
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    odd = F.col("turn") % 7 == 0
    arguments = F.when(odd, F.to_json(F.struct("text", "turn", words.cast("string").alias("words")))).otherwise(F.to_json(F.struct("text", "turn", words.alias("words"))))
    calls = conversations.where("role = 'assistant'").select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn", F.when(F.col("turn") % 5 == 0, "lookup").otherwise("answer").alias("name"),
        arguments.alias("arguments"), F.array_compact(F.array(F.when(F.col("turn") > 2, name(F.col("turn") - 2)))).alias("after"),
    )
    results = conversations.where("role = 'user'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op2_tool_calls(spark, sf_dir: str) -> DataFrame:
    calls, results = calls_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    out = link_calls(calls, results, schema_table(spark, TOOLS))
    return out.withColumn("errors", F.array_join("errors", ", "))


OP2_SQL = """
WITH RECURSIVE a AS (SELECT conv_id, turn, conv_id || ':' || turn AS call_id, CASE WHEN turn % 5 = 0 THEN 'lookup' ELSE 'answer' END AS name, text,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
    CASE WHEN turn > 2 THEN [conv_id || ':' || (turn - 2)] ELSE [] END AS after
  FROM conversations WHERE role = 'assistant'),
u AS (SELECT call_id, unnest(after) AS after FROM a),
k AS (SELECT u.call_id, u.after FROM u JOIN a ON a.call_id = u.after),
paths(call_id, level) AS (SELECT call_id, 0 FROM a WHERE call_id NOT IN (SELECT call_id FROM k)
  UNION SELECT k.call_id, paths.level + 1 FROM k JOIN paths ON k.after = paths.call_id),
l AS (SELECT call_id, max(level) AS level FROM paths GROUP BY call_id),
r AS (SELECT conv_id || ':' || (turn - 1) AS call_id, min(text) AS content, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY ALL),
e AS (SELECT a.*, l.level, r.content, coalesce(r.n, 0) AS n_results, concat_ws(', ',
    CASE WHEN turn % 7 = 0 THEN 'type of words' END, CASE WHEN name = 'lookup' THEN 'unknown turn' END,
    CASE WHEN call_id IN (SELECT call_id FROM u WHERE u.after NOT IN (SELECT call_id FROM a)) THEN 'unknown after' END) AS errors
  FROM a JOIN l USING (call_id) LEFT JOIN r USING (call_id))
SELECT conv_id, call_id, turn, name, CAST(level AS BIGINT) AS level, errors, errors = '' AS valid, n_results,
  CAST(json_object('after', after, 'arguments', CASE WHEN turn % 7 = 0 THEN json_object('text', text, 'turn', turn, 'words', CAST(words AS VARCHAR)) ELSE json_object('text', text, 'turn', turn, 'words', words) END,
    'call_id', call_id, 'conv_id', conv_id, 'level', level, 'name', name, 'result', content, 'turn', turn) AS VARCHAR) AS record
FROM e
"""
