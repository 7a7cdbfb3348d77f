"""Revisit resolution by hand, against a loop, and on odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from assay.llm.revisits import canonical_url, resolve_revisits

SCHEMA = "record_id long, url string, ts long, full boolean, headers map<string,string>, payload string, key string"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://www.Example.org:80/A/b/?b=2&a=1&utm_source=x#top", "example.org/A/b?a=1&b=2"), ("https://example.org", "example.org"), ("https://u:p@example.org:443?", "example.org"),
        ("http://example.org:8080/?ref=x", "example.org:8080"), ("nonsense", None), ("", None), (None, None), ("http:///x", None),
    ],
)
def test_canonical(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(canonical_url(F.col("u")).alias("k")).first().k == want


def test_outcomes(spark):
    u = "http://a.org/x"
    rows = [
        (1, u, 10, True, {"ETag": "t1", "Content-Type": "html", "X": "old"}, "one", "k"), (2, u + "#f", 20, True, {"ETag": "t2", "Last-Modified": "d2"}, "two", "k"), (3, "http://b.org", 5, True, None, "bare", "k"),
        (10, u, 15, False, {"etag": "W/t1", "content-type": "no", "x": "new", "Y": "y"}, None, "k"), (11, u, 20, False, {"etag": "t1"}, None, "k"), (12, u, 9, False, {"etag": "t1"}, None, "k"), (13, None, 9, False, None, None, "k"),
        (14, "http://b.org/", 6, False, {"etag": "z"}, None, "k"), (15, u, 99, None, {"last-modified": "d2"}, None, "k"), (16, u, None, False, {}, None, "k"), (None, u, 50, True, {}, "lost", "k"), (None, u, 60, False, {}, None, "k"),
    ]
    got = {r.record_id: r for r in resolve_revisits(spark.createDataFrame(rows + rows[:5], SCHEMA), slot=7).collect()}
    assert {k: (r.response_id, r.outcome) for k, r in got.items()} == {10: (1, "resolved"), 11: (2, "changed"), 12: (None, "missing"), 13: (None, "invalid"), 14: (3, "unvalidated"), 15: (2, "resolved"), 16: (None, "invalid")}
    assert got[10].headers == {"etag": "W/t1", "content-type": "html", "x": "new", "y": "y"} and got[10].payload == "one" and got[11].payload is None and got[14].payload == "bare"
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("slot", [1, 10, 100_000])
def test_as_of_against_loop(spark, slot):
    rng = random.Random(slot)
    rows = [(i, f"http://h{rng.choice([0, 0, 0, 1, 2])}.org", rng.randrange(120), rng.random() < 0.3, {}, f"p{i}", "k") for i in range(400)]
    got = {r.record_id: r.response_id for r in resolve_revisits(spark.createDataFrame(rows, SCHEMA), slot).collect()}
    want = {}
    for i, url, ts, full, *_ in rows:
        if not full:
            before = [(r[2], r[0]) for r in rows if r[1] == url and r[3] and r[2] <= ts]
            want[i] = max(before)[1] if before else None
    assert got == want
