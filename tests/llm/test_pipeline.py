"""The pipeline: every stage against brute force on what the one before kept."""

import random

import pytest
from test_operators import brute_components, edits, line_key, words

import corpus_pipeline
from assay.llm.quality_knn import quality_scores
from assay.llm.registry import QUERIES, SQL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(21)
    items = [(i, " ".join(words(rng, 15))) for i in range(6)]
    shared = ["a licence line that many documents have", "Another Line That Many Documents Have"]
    docs = []
    for i in range(70):
        body = [" ".join(words(rng, 12)) for _ in range(6)]
        if i % 3 == 0:
            body.insert(rng.randrange(6), rng.choice(shared))
        if i % 10 == 4:
            body.append(items[i % 6][1])
        docs.append((i, "\n".join(body)))
    docs += [(100 + i, docs[i][1].replace("W1 ", "other ")) for i in range(12)] + [(200 + i, docs[5][1]) for i in range(5)] + [(300, shared[0])] * 2
    docs += [(400 + i, " ".join(w.upper() + "!!" for w in words(rng, 60))) for i in range(40)] + [(500, None), (501, "")]
    rows = [(d, t, "en", f"s{d % 4}", len(t) if t else None) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(d < 400), 0) for d, _ in docs if d % 5 and d not in (300, 500, 501)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), items


def test_stages(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = stage(spark, docs, path).persist()
        kept[name] = (before, [r.asDict() for r in docs.collect()])
        assert docs.columns[:5] == COLUMNS
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS

    texts = lambda rows: sorted((r["doc_id"], r["text"]) for r in rows)
    before, after = kept["quality classifier"]
    scored = quality_scores(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")).collect()
    assert texts(after) == sorted((r.doc_id, r.text) for r in scored if r.predicted == 1)
    assert {r["doc_id"] for r in after} >= set(range(70)) and not {r["doc_id"] for r in after} & set(range(400, 502))

    before, after = kept["line dedup"]
    holders = {}
    for d, t, *_ in before:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= 20:
                holders.setdefault(line_key(line), set()).add(d)
    want = []
    for d, t, *_ in before:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(holders.get(line_key(x), ())) < 3 or d == max(holders[line_key(x)])]
        if stay == lines or "\n".join(stay).strip():
            want.append((d, "\n".join(stay)))
    assert texts(after) == sorted(want)

    before, after = kept["n-gram Jaccard join"]
    rows = [(d, t) for d, t, *_ in before]
    assert {r["doc_id"] for r in after} == {c for _, _, c in brute_components(rows)}
    assert len(after) == len({r["doc_id"] for r in after})

    before, after = kept["benchmark decontamination"]
    split = lambda x: (x or "").lower().split()
    clean = [d for d, t, *_ in before if all(edits(split(i), split(t)) > int(len(split(i)) * 0.15) for _, i in items)]
    assert [d for d, _ in texts(after)] == sorted(clean) and len(clean) < len(before)

    before, after = kept["mixing sources"]
    assert {r["doc_id"] for r in after} <= {d for d, *_ in before} and all(0 < r["taken"] <= 2 * r["size"] for r in after)
    assert 1.2 * sum(len(split(t)) for _, t, *_ in before) < sum(r["taken"] for r in after) < 1.8 * sum(len(split(t)) for _, t, *_ in before)


ODD = "doc_id long, text string, lang string, source string, n_chars long, matches string, score string, n_lines string, n_dropped string, predicted string, root string, t string"


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows(spark, folder, stage):
    """Nulls, empty and long texts, repeated rows, clashing columns, and no rows at all."""
    path, items = folder
    rng = random.Random(8)
    text = " ".join(words(rng, 40))
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, text), (None, None), (4, text), (4, text), (5, " ".join(words(rng, 8000))), (6, items[0][1])]
    docs = spark.createDataFrame([(d, t, None, None, None, *"abcdefg") for d, t in rows], ODD)
    name, run = corpus_pipeline.STAGES[stage]
    own = [c.split()[0] for c in ODD.split(", ")]
    assert run(spark, docs.limit(0), path).count() == 0
    out = run(spark, docs, path)
    got = out.collect()
    assert out.columns[: len(own)] == own and all((r.matches, r.score, r.n_lines, r.root) == ("a", "b", "c", "f") for r in got)
    left = sorted((r.doc_id or 0, r.text or "") for r in got)
    every = sorted((d or 0, t or "") for d, t in rows)
    if name == "n-gram Jaccard join":
        assert [d for d, _ in left] == [0, 1, 2, 3, 4, 5, 6]
    elif name == "benchmark decontamination":
        assert left == [x for x in every if x[0] != 6]
    elif name == "line dedup":
        assert left == every
    else:
        assert set(left) <= {x for x in every if x[1].strip()}


def test_whole_run(spark, folder, tmp_path):
    path, items = folder
    rows = corpus_pipeline.run(spark, path).collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) > 30 and all(r.taken > 0 for r in rows) and not set(ids) & set(range(400, 502))
    split = lambda x: (x or "").lower().split()
    assert all(edits(split(i), split(r.text)) > int(len(split(i)) * 0.15) for r in rows for _, i in items)


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(SQL) <= set(QUERIES) and 4 <= len(corpus_pipeline.STAGES) <= 5
