import random
import re

import pytest
from pyspark.sql import functions as F

from assay.functions.matching import in_order, rung
from assay.functions.text import SUFFIXES, stem, stems, tokens, without_stopwords


def col(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i")


def test_tokens(spark):
    got = [r.t for r in col(spark, ["Don't STOP, 24/7!", "étion ÇA x'y'z", "", None]).select(tokens(F.col("x")).alias("t")).collect()]
    assert got == [["don't", "stop", "24", "7"], ["tion", "a", "x'y", "z"], [], []]


def test_negations_are_no_stopwords(spark):
    row = spark.sql("SELECT 'it is not in the box, no' AS x").select(without_stopwords(tokens(F.col("x"))).alias("t")).first()
    assert row.t == ["not", "box", "no"]


@pytest.mark.parametrize(("word", "want"), [("policies", "policy"), ("sing", "sing"), ("testing", "test"), ("tried", "try"), ("died", "died"), ("used", "used"), ("added", "add"), ("cases", "cas"), ("case", "case"), ("bus", "bus"), ("cars", "car"), ("fly", "fly"), ("quickly", "quick"), ("ties", "tie")])
def test_stem(spark, word, want):
    assert spark.range(1).select(stem(F.lit(word)).alias("s")).first().s == want


def test_stem_against_loop(spark):
    def one(word):
        for suffix, to in SUFFIXES:
            if word.endswith(suffix) and len(word) - len(suffix) + len(to) >= 3:
                return word[: len(word) - len(suffix)] + to
        return word

    rng = random.Random(5)
    words = ["".join(rng.choice("abie") for _ in range(rng.randint(1, 4))) + rng.choice(["", "ies", "ing", "ied", "ed", "es", "s", "ly"]) for _ in range(400)]
    got = [r.s for r in col(spark, words).select(stem(F.col("x")).alias("s")).collect()]
    assert got == [one(w) for w in words]


def greedy(wanted, words, gap):
    if not wanted:
        return False
    for start in (i for i, w in enumerate(words) if w == wanted[0]):
        at = start
        for token in wanted[1:]:
            near = [i for i in range(at + 1, min(at + 2 + gap, len(words))) if words[i] == token]
            if not near:
                break
            at = near[0]
        else:
            return True
    return False


def test_gaps_are_greedy(spark):
    rng = random.Random(3)
    rows = [(["a", "b", "c"], "a b b x x c".split())] + [([rng.choice("abc") for _ in range(rng.randint(0, 4))], [rng.choice("abcx") for _ in range(rng.randint(0, 9))]) for _ in range(800)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p array<string>, w array<string>")
    got = [r.m for r in df.orderBy("i").select(in_order(F.col("p"), F.col("w"), 2).alias("m")).collect()]
    assert got == [greedy(p, w, 2) for p, w in rows]
    assert got[0] is False


@pytest.mark.parametrize(
    ("pattern", "text", "want"),
    [
        ("24 hours", "done in 24 hours", "exact"), ("instant", "It arrives INSTANTLY", "exact"), ("reset", "preset values", "exact"), ("  Hours ", "24 hours", "exact"),
        ("send your password", "we send you your password", "subsequence"), ("send password", "send one two three password", None), ("renew passwords", "renewing the password", "stemmed_subsequence"), ("reset passwords", "resetting the password", None),
        ("review is pending", "reviews pending", "stemmed_subsequence"), ("cannot view", "can view", None), ("", "anything", None), ("   ", "anything", None), ("the of", "x y", None),
    ],
)
def test_ladder(spark, pattern, text, want):
    df = spark.createDataFrame([(pattern, text)], "p string, x string")
    w = tokens(F.col("x"))
    assert df.select(rung(F.col("p"), F.col("x"), w, stems(w)).alias("r")).first().r == want


def test_marker_quirk(spark):
    from assay.operators.taxonomy import has_marker

    df = col(spark, ["100% sure", "100%x", "No Exceptions here", "instants", "without fail", None])
    assert [r.m for r in df.select(has_marker(F.col("x")).alias("m")).collect()] == [bool(re.search(r"(?i)\b100%\b", "100% sure")), True, True, False, True, False]
