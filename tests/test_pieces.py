"""Numbered lines and JSON arrays of many splits, against Python's parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from assay.sources.inputs import read_array
from assay.sources.pieces import numbered_lines, strictly

VALUES = ["", "a,b", 'q"uote', "br]ack[et}{", "back\\slash\\", "tab\t\nline", "é中,", '","', "\\\"", "[1,2]", 1, -2.5, True, None, [], {}, [1, [2, 3], {"k": "v,\\"}], {"a": {"b": [",", "]"]}, "c": ""}]


@pytest.fixture
def small_splits(spark, monkeypatch):
    """Splits of a few dozen bytes: elements and strings reach over several of them, and no file is one row."""
    monkeypatch.setattr("assay.sources.inputs.WHOLE_BYTES", -1)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "61")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 1])
def test_elements_of_many_splits(spark, small_splits, tmp_path, indent):
    rng = random.Random(4)
    items = [rng.choice(VALUES) if rng.random() < 0.5 else {"id": i, "x": rng.choice(VALUES), "y": [rng.choice(VALUES)]} for i in range(60)]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(items, indent=indent, ensure_ascii=False), encoding="utf-8")
    assert spark.read.text(str(path), lineSep=",").rdd.getNumPartitions() > 5
    rows, bad = read_array(spark, str(path))
    got = rows.select("idx", "raw", F.to_json("record").alias("j")).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(len(items)))
    assert [json.loads(r.raw) for r in got] == items
    assert [json.loads(r.j) for r in got] == items
    assert bad.count() == 0


BAD = ["", "[", "[1,]", "[1,,2]", "[1] [2]", "[1]]", "[1, 2] x", '["a, 2]', "[1}", '{"a":1,}', '[{"a":1},{"b"]', "1,2", '[{"a":1} 2]']
OTHER = ['{"a": 1, "b": [1, 2]}', "{}", '"a,b"']
GOOD = [" [ ] ", '["]"]', "[1\n,\n2 ]\n", '[{"a":"}"},null]']


def test_what_is_an_array(spark, small_splits, tmp_path):
    for k, text in enumerate(BAD + OTHER + GOOD):
        path = tmp_path / f"{k}.json"
        path.write_text(text, encoding="utf-8")
        rows, bad = read_array(spark, str(path))
        codes = [r.code for r in bad.collect()]
        want = ["INVALID_JSON"] if text in BAD else ["NOT_AN_ARRAY"] if text in OTHER else []
        assert codes == want, text
        assert [json.loads(r.raw) for r in rows.orderBy("idx").collect()] == (json.loads(text) if text in GOOD else []), text


def test_small_files_give_the_same(spark, tmp_path):
    """One row for the whole of a small file: the same elements, or the same issue."""
    for k, text in enumerate(["[1] [2]", "[1]]", "1,2", "{}", *GOOD]):
        path = tmp_path / f"{k}.json"
        path.write_text(text, encoding="utf-8")
        rows, bad = read_array(spark, str(path))
        assert [r.code for r in bad.collect()] == (["NOT_AN_ARRAY"] if text == "{}" else [] if text in GOOD else ["INVALID_JSON"]), text
        assert rows.count() == (len(json.loads(text)) if text in GOOD else 0)


def test_nothing_after_a_value(spark):
    bad = ['{"a":1} x', '{"a":1},"b":2', '{"a":1}, {"b":2}', "1 2", "", " ", "{", '"a', '{"a":1}}', '{"a":1,"a":2}']
    good = ['{"a":1}', ' {"a":[1,"}"]} ', "1", "null", '"x"']
    rows = spark.createDataFrame([(x,) for x in bad + good], "x string").select("x", strictly(F.col("x")).isNotNull().alias("ok"))
    assert {r.x for r in rows.collect() if r.ok} == set(good)


def test_lines_of_many_splits(spark, small_splits, tmp_path):
    rng = random.Random(6)
    lines = ["".join(rng.choice("abé, ") for _ in range(rng.choice([0, 1, 30, 200]))) for _ in range(90)]
    for name, part in (("1", lines[:40]), ("2", lines[40:])):
        (tmp_path / f"p{name}.txt").write_text("".join(x + rng.choice(["\n", "\r\n"]) for x in part), encoding="utf-8", newline="")
    rows = numbered_lines(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 5
    assert sorted((r.line, r.value) for r in rows.collect()) == list(enumerate(lines, 1))


def test_an_array_is_written_once(spark, tmp_path, monkeypatch):
    """Elements are kept as their text alone: a parsed copy beside it would double what is written."""
    from assay.sources import pieces

    path, tables = tmp_path / "a.json", {}
    path.write_text('[{"a": 1}, "two", [3]]')
    keep = pieces.kept
    monkeypatch.setattr(pieces, "kept", lambda table, name: tables.setdefault(name, keep(table, name)))
    rows, wrong = pieces.array_elements(spark, str(path))
    assert wrong == "" and [(r.idx, r.raw, str(r.record)) for r in rows.orderBy("idx").collect()] == [(0, '{"a": 1}', '{"a":1}'), (1, '"two"', '"two"'), (2, "[3]", "[3]")]
    assert "record" not in tables["array-records"].columns
