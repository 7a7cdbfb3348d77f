"""Scores in blocks of documents against all pairs: ties, repeated and null ids, few rows that leave a task."""

import math
import random
import weakref
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assay.functions.text import stemmed, stems, tokens
from assay.operators import blocks, index, retrieval
from assay.operators.blocks import best_in_blocks
from assay.operators.index import search, write_index
from assay.operators.retrieval import bm25_topk

CONFIG = {"top_k": 3, "bm25_k1": 1.5, "bm25_b": 0.75, "score_precision": 4}


def test_blocks_send_only_the_best(spark, monkeypatch):
    """Every query meets every document, but a block gives some rows a query, also where hundreds of documents tie; the best k are those of all pairs."""
    monkeypatch.setattr(blocks, "DOCS", 100)
    rng = random.Random(4)
    values = [(t, f"d{d}", (1 + t % 3) / 8 if d % 2 else rng.random()) for d in range(400) for t in rng.sample(range(20), 5) + [20]] + [(3, None, 5.0), (3, "d1", 0.5), (4, "d1", 0.5)]
    asked = [(f"q{q}", t, rng.choice([1, 1, 2])) for q in range(30) for t in rng.sample(range(20), 3) + [20, 99]]
    got = best_in_blocks(spark.createDataFrame(values, "tid int, doc_id string, weight double"), spark.createDataFrame(asked, "query_id string, tid int, times long"), 401, 2, 4).collect()
    assert len(got) < 30 * 401 / 10
    want = defaultdict(float)
    for q, t, n in asked:
        for u, d, w in values:
            if t == u:
                want[q, d] += n * w
    assert all(abs(r.score - want[r.query_id, r.doc_id]) < 1e-9 for r in got)
    best = lambda pairs, q: sorted((-round(s, 4), d or "") for (p, d), s in pairs.items() if p == q)[:2]
    found = {(r.query_id, r.doc_id): r.score for r in got}
    assert len(found) == len(got) and all(best(found, f"q{q}") == best(want, f"q{q}") for q in range(30))


def test_many_queries_share_the_blocks_of_an_index(spark, tmp_path, monkeypatch):
    """A search of many queries forms no pairs outside of blocks and gives what few queries are given."""
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choices([f"term{i}" for i in range(30)], k=n))
    kb = spark.createDataFrame([(f"d{i}", None, text(i % 40)) for i in range(120)], "doc_id string, title string, text string")
    queries = spark.createDataFrame([(f"q{i}", text(i)) for i in range(15)] + [("none", None)], "query_id string, user_question string")
    made = write_index(kb, f"{tmp_path}/index", CONFIG)
    rows = lambda: sorted(map(tuple, search(made, queries, CONFIG).collect()))
    few, calls = rows(), []
    assert few == sorted(map(tuple, bm25_topk(kb, queries, CONFIG).collect()))
    for module, bound in ((index, "MANY"), (retrieval, "PRUNE_FROM")):
        monkeypatch.setattr(module, bound, 0)
        monkeypatch.setattr(module, "best_in_blocks", lambda *a: calls.append(a) or best_in_blocks(*a))
    assert rows() == few == sorted(map(tuple, bm25_topk(kb, queries, CONFIG).collect())) and len(calls) == 2 and len(few) == 48


def _no_hash_of_words(table):
    """The plan moves rows by no document's id, which a count of its words would."""
    return "hashpartitioning(doc_id" not in table._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_document_are_counted_without_a_shuffle(spark, monkeypatch):
    """Retrieval writes a row for each document, of words that no shuffle moved; also where a document spans batches, and as a shuffle would count them."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choices([f"term{i}" for i in range(12)], k=n))
    some = [(f"d{i}", None, text(i % 23)) for i in range(90)]
    kb = spark.createDataFrame([*some, *some[5:8], (None, None, "term1 term1"), ("d9", None, "term1"), ("long", "x", text(500))], "doc_id string, title string, text string").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", text(1 + i % 4)) for i in range(12)] + [("none", None)], "query_id string, user_question string")
    made, keep = {}, retrieval.kept

    def kept(table, name):
        made[name] = _no_hash_of_words(table)
        out = keep(table, name)
        if name == "bm25-postings":
            made["rows"] = sorted((r.doc_id or "", r.length, r.tids, r.tfs) for r in out.collect())
        return out

    monkeypatch.setattr(retrieval, "kept", kept)
    rows = lambda: sorted(map(tuple, bm25_topk(kb, queries, CONFIG).collect()))
    whole = rows()
    assert made["bm25-postings"] and len(made["rows"]) == 96 and "bm25-merged" in made
    lists = made["rows"]
    for name, value in (("PRUNE_FROM", 0), ("BROADCAST_TERMS", 3)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        try:
            monkeypatch.setattr(retrieval, name, value)
            assert rows() == whole and made["rows"] == lists
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # Scores by hand: repeated ids of one length are one document, whose words add up.
    docs = defaultdict(list)
    for r in kb.collect():
        docs[r.doc_id, len(f"{r.title or ''} {r.text}".split())] += f"{r.title or ''} {r.text}".split()
    sizes = [len(f"{r.title or ''} {r.text}".split()) for r in kb.collect()]
    n, mean = len(sizes), sum(sizes) / len(sizes)
    df = {t: sum(t in words for words in docs.values()) for t in {w for words in docs.values() for w in words}}
    for q, question in queries.collect():
        want = defaultdict(float)
        for (doc, size), words in docs.items():
            want[doc] += sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * words.count(t) * 2.5 / (words.count(t) + 1.5 * (0.25 + 0.75 * size / mean)) for t in (question or "").split() if t in words)
        best = sorted((-s, d or "") for d, s in want.items())[:3]
        assert all(abs(-s - r[3]) < 1e-4 for (s, _), r in zip(best, [r for r in whole if r[0] == q], strict=True))


def test_only_named_texts_move(spark, monkeypatch):
    """Of many queries, too, no text that isn't retrieved is shuffled, and all ways give the same passages."""
    kb = spark.createDataFrame([(f"d{i}", None if i % 3 else f"t{i}", f"text {i}") for i in range(40)] + [(None, "no", "id")], "doc_id string, title string, text string")
    top = spark.createDataFrame([(f"q{i}", r, f"d{(i * r) % 7}", 1.0 / r) for i in range(9) for r in (1, 2)], "query_id string, rank int, doc_id string, score double")
    queries = top.select("query_id").distinct()
    rows = lambda table: sorted((r.query_id, [tuple(p) for p in r.retrieved]) for r in table.collect())
    few, many = retrieval.passages(top, kb, queries), retrieval.passages(top, kb, queries, 0)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert rows(few) == rows(many) and len(rows(few)) == 9 and "hashpartitioning(doc_id" not in plan
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    plan = retrieval.passages(top, kb, queries, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert rows(retrieval.passages(top, kb, queries, 0)) == rows(few) and "LeftSemi" in plan


@pytest.mark.parametrize(("pilot", "same", "copies"), [(2, 1.0, 6), (2, 0.0, 6), (99, 0.9, 1), (2, 0.9, 1)])
def test_bounds_and_like_rows_change_nothing(spark, monkeypatch, pilot, same, copies):
    """With bounds of some blocks or without, and with copies of documents and of questions scored once or each, the best are those of all pairs."""
    for name, value in (("DOCS", 20), ("FEW", 20), ("PILOT", pilot), ("SAME", same)):
        monkeypatch.setattr(blocks, name, value)
    weigh = lambda tf, length: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / 20))
    rng = random.Random(6)
    some = [(rng.randint(5, 40), sorted(rng.sample(range(40), rng.randint(0, 12)))) for _ in range(240 // copies)]
    docs = [(f"d{c}x{i}", n, tids, [1 + (i + t) % 3 for t in tids]) for i, (n, tids) in enumerate(some) for c in range(copies)] + [(None, 9, [1, 2], [1, 4])]
    questions = [sorted(rng.choices(range(42), k=rng.choice([1, 3, 8]))) for _ in range(30)] + [[41]]
    asked = [(f"q{c}x{i}", t, tids.count(t)) for i, tids in enumerate(questions) for c in range(copies) for t in sorted(set(tids))] + [(None, 1, 2), (None, 2, 1)]
    factors = [(t, 1 + t / 7) for t in range(42)]
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    parts, run = [], blocks._in_parts
    monkeypatch.setattr(blocks, "_in_parts", lambda docs, queries, *a: parts.append((docs.count(), queries.count())) or run(docs, queries, *a))
    got = best_in_blocks(
        made(docs, "doc_id string, length long, tids array<int>, tfs array<int>"), made(asked, "query_id string, tid int, times long"), len(docs), 2, 4, made(factors, "tid int, factor double"), weigh,
    ).collect()
    held = sum(bool(d[2]) for d in docs)
    assert len(parts) == (2 if pilot == 2 else 1) and all(q <= 32 for _, q in parts)
    assert sum(n for n, _ in parts) == held if not (copies > 1 and same == 1.0) else sum(n for n, _ in parts) < held / 4
    want = defaultdict(float)
    for q, t, n in asked:
        for d, length, tids, tfs in docs:
            if t in tids:
                want[q, d] += n * factors[t][1] * weigh(tfs[tids.index(t)], length)
    found = {(r.query_id, r.doc_id): r.score for r in got}
    best = lambda pairs, q: sorted((-round(s, 4), d or "") for (p, d), s in pairs.items() if p == q)[:2]
    assert len(found) == len(got) and all(abs(s - want[p]) < 1e-9 for p, s in found.items())
    assert all(best(found, q) == best(want, q) for q in {q for q, _, _ in asked})


@pytest.mark.parametrize("units", [65_535, 900, 1])
def test_short_sums_find_what_scores_do(monkeypatch, units):
    """Sums in units, all scores where they would not fit, and hundreds of ties: each query's best of a block, with a bound and without."""
    monkeypatch.setattr(blocks, "UNITS", units)
    rng = np.random.default_rng(1)
    tids = [np.sort(rng.choice(30, rng.integers(1, 9), replace=False)) for _ in range(400)]
    values = [np.where(t < 15, 0.5, 0.1 + t / 9) for t in tids]
    rows = pa.table({"ids": [[f"d{i}"] for i in range(400)], "tids": pa.array(tids, pa.list_(pa.int32())), "values": values, "tfs": pa.nulls(400), "length": pa.nulls(400)})
    block, names = blocks._Block(rows, 3, 2e-4, None), sorted(f"d{i}" for i in range(400))
    for terms in ([0], [1, 1, 4], [20, 25, 29], list(range(30))):
        all_of = np.array([sum(terms.count(t) * v for t, v in zip(tids[int(d[1:])].tolist(), values[int(d[1:])].tolist(), strict=True)) for d in names])
        first = sorted(range(400), key=lambda d: (-round(all_of[d], 4), d))[:3]
        for bound in (0.0, all_of[first[-1]] - 2e-4):
            found, scores = block.best(terms, sum(int(block.most[t]) for t in terms), bound)
            assert np.allclose(scores, all_of[found]) and sorted(found.tolist(), key=lambda d: (-round(all_of[d], 4), d))[:3] == first and len(found) < 100


def test_a_task_holds_a_batch_of_queries(monkeypatch):
    """A block's best are sent on for a batch of queries before the next one is read, and nothing is held of the one before."""
    columns = {"part": pa.int32(), "kind": pa.int32(), "ids": pa.list_(pa.string()), "nos": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "tids": pa.list_(pa.int32()), "values": pa.list_(pa.float64())}
    row = lambda **given: pa.RecordBatch.from_arrays([pa.array([given.get(c)], t) for c, t in columns.items()], list(columns))
    events, alive = [], []

    def batches():
        yield row(part=0, kind=0, ids=["a"], tids=[1, 2], values=[1.0, 2.0])
        for n in range(5):
            events.append("in")
            batch = row(part=0, kind=1, nos=[n], sizes=[1], tids=[1], values=[0.0])
            alive.append(weakref.ref(batch))
            yield batch
            del batch

    for out in blocks._scorer(1, 0.0, None)(batches()):
        events.append("out")
        assert out.to_pylist() == [{"no": len(events) // 2 - 1, "doc_id": "a", "score": 1.0}] and sum(r() is not None for r in alive) <= 2
    assert events == ["in", "out"] * 5


def test_words_and_stems_in_python_are_those_of_columns(spark):
    texts = ["It's the dogs' o'clock's 'tis a''b don't's x'9 9'x", "Straße İstanbul K Ünïted ﬁling FLIES flying tied bed ly sly fully", "", "a_b-c 12,5% ÉTÉ cafés ªº ²", None, "'", "x'y'z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.coalesce(F.lower("t"), F.lit("")).alias("low"), tokens(F.col("t")).alias("w"), stems(tokens(F.col("t"))).alias("s")).collect()
    for r in rows:
        words = [w.decode() for w in blocks.words_of(r.low.encode())]
        assert words == r.w and [stemmed(w) for w in words] == r.s
