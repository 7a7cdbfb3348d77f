"""The stored index against retrieval from texts, phrases against the ladder on all pairs, fingerprints, running sums."""

import random
import shutil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assay.functions.matching import rung
from assay.functions.text import stems, tokens
from assay.operators import index
from assay.operators.index import open_index, search, write_index
from assay.operators.ordered import with_running
from assay.operators.phrases import phrase_matches
from assay.operators.retrieval import bm25_topk
from assay.operators.validate import differences, differing_parts, row_texts

CONFIG = {"top_k": 3, "bm25_k1": 1.5, "bm25_b": 0.75, "score_precision": 4}


@pytest.mark.parametrize("block", [2, 128])
def test_searches_need_no_texts(spark, tmp_path, monkeypatch, block):
    """Two searches after the texts are gone give what retrieval from texts gave, zero scores and ties too."""
    monkeypatch.setattr(index, "BLOCK", block)
    rng = random.Random(3)
    vocabulary = [f"term{i}" for i in range(40)] + ["running", "runs", "the"]
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    docs = [(f"d{i}", rng.choice([None, "title", "runs"]), " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 3, 20, 60])))) for i in range(150)] + [("dx", None, None), ("dy", "", "")]
    spark.createDataFrame(docs, "doc_id string, title string, text string").write.parquet(f"{tmp_path}/kb")
    kb = spark.read.parquet(f"{tmp_path}/kb")
    asked = [[("q0", "term0 term1 term39"), ("q1", "the nothing"), ("q2", "Running term5 term5 term7"), ("q3", ""), ("q4", " ".join(vocabulary))], [("p0", "term3 term12"), ("p1", None)]]
    tables = [spark.createDataFrame(rows, "query_id string, user_question string") for rows in asked]
    want = [sorted(map(tuple, bm25_topk(kb, q, CONFIG).collect())) for q in tables]
    write_index(kb, f"{tmp_path}/index", CONFIG)
    shutil.rmtree(f"{tmp_path}/kb")
    for q, rows in zip(tables, want, strict=True):
        assert sorted(map(tuple, search(open_index(spark, f"{tmp_path}/index"), q, CONFIG).collect())) == rows
    assert len(want[0]) == 15


def test_an_index_of_nothing(spark, tmp_path):
    made = write_index(spark.createDataFrame([("d", None, None)], "doc_id string, title string, text string"), f"{tmp_path}/index", CONFIG)
    got = search(made, spark.createDataFrame([("q", "word")], "query_id string, user_question string"), CONFIG).collect()
    assert [tuple(r) for r in got] == [("q", 1, "d", 0.0)]


def test_phrases_as_on_all_pairs(spark):
    rng = random.Random(9)
    vocabulary = ["art", "party", "parts", "walk", "walking", "walked", "don't", "don", "t", "state-of-the-art", "x", "ab", "café", "naïve", "№1", "12,5", "the", "of"]
    texts = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 25])))) for i in range(60)] + [(100, None), (101, ""), (102, "中文 % text"), (103, "PARTY  of\nthe ART")]
    patterns = ["art", "ART ", "t", "x ab", "party of", "walks parts", "walking the art", "walk art party x", "of the", "state of art", "don't", "n't do", "é", "%", "中", "  ", "", None, "part", "rty of th", "the", "nothing here", "art art art", "12,5 x", "-of-"]
    patterns = [(f"p{i}", p) for i, p in enumerate(patterns)] + [(f"r{i}", " ".join(rng.choices(vocabulary, k=rng.choice([2, 3, 4])))) for i in range(30)]
    left, right = spark.createDataFrame(patterns, "pattern_id string, pattern string"), spark.createDataFrame(texts, "text_id long, text string")
    got = sorted(map(tuple, phrase_matches(left, right).select("pattern_id", "text_id", "rung").collect()))
    pairs = left.crossJoin(right).where("pattern IS NOT NULL AND text IS NOT NULL").withColumn("w", tokens(F.col("text"))).withColumn("s", stems(F.col("w")))
    want = pairs.select("pattern_id", "text_id", rung(F.col("pattern"), F.col("text"), F.col("w"), F.col("s")).alias("rung")).where("rung IS NOT NULL")
    assert got == sorted(map(tuple, want.collect())) and {r for _, _, r in got} == {"exact", "subsequence", "stemmed_subsequence"}
    assert phrase_matches(left.limit(0), right).count() == phrase_matches(left, right.limit(0)).count() == 0


def test_fingerprints_find_the_parts_that_differ(spark):
    a = spark.range(3000).select("id", (F.col("id") % 7).alias("x"))
    b = a.where("id <> 5").withColumn("x", F.when(F.col("id") == 77, 9).otherwise(F.col("x"))).unionByName(a.where("id = 1000"))
    assert differing_parts(row_texts(a), row_texts(a.repartition(7))).count() == 0
    assert differing_parts(row_texts(a), row_texts(b)).count() <= 4
    got = sorted((r.location, r.message) for r in differences(a, b).collect())
    assert got == sorted([("stored", '{"id":5,"x":5}'), ("stored", '{"id":77,"x":0}'), ("computed", '{"id":77,"x":9}'), ("computed", '{"id":1000,"x":6}')])


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(9)) for i in range(500)]
    shuffled = rng.sample(rows, len(rows))
    got = sorted((r.k, r.pos, r.before) for r in with_running(spark.createDataFrame(shuffled, "k long, size long").repartition(5), ["k"], "size", "running").collect())
    total, want = 0, []
    for i, (k, size) in enumerate(rows):
        want.append((k, i, total))
        total += size
    assert got == want


def test_a_text_moves_once_for_all_its_phrases(spark, monkeypatch):
    """Candidates of a text are one row: texts aren't multiplied by their phrases before they are sorted or shuffled, nor are their words made distinct in a shuffle."""
    patterns = spark.createDataFrame([(f"p{i}", f"word{i} common") for i in range(20)], "pattern_id string, pattern string")
    texts = spark.createDataFrame([(i, " ".join(f"word{j} common" for j in range(20))) for i in range(3)], "text_id long, text string")
    found = phrase_matches(patterns, texts)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 60 and "Sort [pattern" not in plan
    lists = [line for line in plan.splitlines() if "collect_list(struct(pattern_id" in line and "Aggregate [text_id" in line]
    assert lists


def test_an_index_moves_postings_in_lists(spark, tmp_path, monkeypatch):
    """Words and postings are no tables of their own on the way; ids that repeat, with one length or several, and no id, are found as retrieval finds them, by few queries and by many."""
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choices([f"term{i}" for i in range(25)], k=n))
    once = [(f"d{i}", rng.choice([None, "title"]), text(i % 17)) for i in range(70)]
    queries = spark.createDataFrame([(f"q{i}", text(1 + i % 5)) for i in range(9)] + [(None, "term1")], "query_id string, user_question string")
    names, keep = [], index.kept
    monkeypatch.setattr(index, "kept", lambda table, name: names.append(name) or keep(table, name))
    for n, docs in enumerate([once, [*once, *once[5:9], ("d9", None, "term1 term2"), (None, None, "term1"), ("d12", "x", None)]]):
        names.clear()
        kb = spark.createDataFrame(docs, "doc_id string, title string, text string").repartition(3)
        made = write_index(kb, f"{tmp_path}/index{n}", CONFIG)
        assert names == ["index-merged"] * n
        want = sorted(map(str, bm25_topk(kb, queries, CONFIG).collect()))
        for many in (10**9, 0):
            monkeypatch.setattr(index, "MANY", many)
            assert sorted(map(str, search(made, queries, CONFIG).collect())) == want
        monkeypatch.setattr(index, "BROADCAST_TERMS", 3)
        assert sorted(map(str, search(made, queries, CONFIG).collect())) == want
        monkeypatch.undo()
        monkeypatch.setattr(index, "kept", lambda table, name: names.append(name) or keep(table, name))


def test_blocks_of_a_term_of_many_batches():
    """A term's rows go on over batches; blocks are of one term, of falling weights, and a term of many documents is cut before all of it is there."""
    rng = random.Random(2)
    want = {t: [(1000 * i + j, rng.randint(1, 9), rng.randint(1, 50)) for i in range(n) for j in range(rng.randint(1, 4))] for t, n in (("a", 1), ("b", 300), ("c", 2), ("d", 1), ("e", 90))}
    rows = [(t, x) for t, docs in want.items() for x in (docs[i : i + 3] for i in range(0, len(docs), 3))]

    def batches(n):
        for i in range(0, len(rows), n):
            some = rows[i : i + n]
            lists = [pa.array([[p[c] for p in x] for _, x in some], pa.list_(t)) for c, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in some]), *lists], ["term", "docs", "tfs", "lengths"])

    for n in (1, 7, 1000):
        out = [b.to_pylist() for b in index._in_blocks(lambda tf, length: tf / length, 4)(batches(n))]
        found = {t: [] for t in want}
        for r in (r for b in out for r in b):
            assert 1 <= len(r["docs"]) <= 4 and r["most"] == r["weights"][0] and r["weights"] == sorted(r["weights"], reverse=True)
            found[r["term"]] += zip(r["docs"], r["weights"], strict=True)
        assert {t: sorted(x) for t, x in found.items()} == {t: sorted((d, tf / length) for d, tf, length in x) for t, x in want.items()}
        assert n > 7 or max(sum(len(r["docs"]) for r in b) for b in out) < 4 * index.TOGETHER + 7 * 12
