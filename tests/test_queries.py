"""Every query that has SQL agrees with it on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from assay.plans import queries as engine

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_agrees(spark, duck, name):
    got = engine.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(engine.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)

    def text(df):
        return sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))

    assert text(got) == text(want)


def test_doc_freq_of_the_whole_corpus(spark, duck):
    """Every term that any document holds is counted, whether or not a question asks for it."""
    every = {r.term: r.df for r in engine.QUERIES["bm25_corpus_doc_freq"](spark, SF).collect()}
    words = duck.execute(f"SELECT DISTINCT unnest({engine._sql_terms("coalesce(source, '') || ' ' || coalesce(text, '')")}) FROM documents").fetchall()
    assert set(every) == {w for (w,) in words}
    asked = {r.term: r.df for r in engine.QUERIES["bm25_doc_freq"](spark, SF).collect()}
    assert asked.items() < every.items()


def test_review_validation_of_all_variants(spark, duck):
    """Conversations without an answer in turn 1 are validated too, as are maps over several variants."""
    got = {r.problem: r.n for r in engine.QUERIES["review_validation_all"](spark, SF).collect()}
    turns = dict(duck.execute("SELECT conv_id, count(DISTINCT turn) FROM conversations WHERE role = 'assistant' GROUP BY conv_id").fetchall())
    assert max(turns.values()) > 1
    assert got["no valid review"] == sum(c % 4 < 3 for c in turns)
    assert got["faithfulness must have the variants as keys"] == sum(c % 4 == 2 for c in turns)


def test_later_stages_over_real_scores(spark, duck):
    """A tag for a missed document stands exactly where the real retrieval missed."""
    missed = {(r.query_id, r.variant) for r in engine.QUERIES["evaluated_failure_tags_of_answers"](spark, SF).collect() if "retrieval_miss" in r.tags.split(",")}
    rows = duck.execute(engine.SQL["automated_scores"]).df()
    assert missed == set(rows[~rows.retrieval_hit][["query_id", "variant"]].itertuples(index=False, name=None))


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(engine.QUERIES) == set(engine.SQL)
    assert entry.entry(spark).count() > 0
