"""What stays in the shared folder after a query."""

import os

from assay.operators.kept import kept, kept_alone
from assay.plans import queries


def test_steps_of_a_kept_table_go(spark, monkeypatch, tmp_path):
    """The inner table is a step of the outer one, and its own step is gone before the outer one is made; tables kept before stay."""
    monkeypatch.setattr("assay.operators.kept.shared_folder", lambda _: str(tmp_path))
    first, seen = kept(spark.range(3), "first"), []

    def inner():
        return kept(spark.range(5), "step").where("id > 1")

    def outer():
        out = kept_alone(inner, "inner").join(first, "id", "left_anti")
        seen.extend(x.name.split("-")[0] for x in tmp_path.iterdir())
        return out

    out = kept_alone(outer, "outer")
    assert sorted(seen) == ["first", "inner"] and sorted(x.name.split("-")[0] for x in tmp_path.iterdir()) == ["first", "outer"]
    assert sorted(r.id for r in out.collect()) == [3, 4] and first.count() == 3 and kept(spark.range(1), "more").count() == 1


def test_evaluated_queries_keep_scores_only(spark, monkeypatch, tmp_path):
    """Postings, terms and ranks of retrieval are gone when scores, and texts for prompts, are kept."""
    monkeypatch.setattr("assay.operators.kept.shared_folder", lambda _: str(tmp_path))
    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    left = lambda: sorted(x.name.rsplit("-", 1)[0] for x in tmp_path.iterdir())
    for name in ("composite_score", "failure_tag_counts", "judge_stub_reviews", "failure_tags_of_answers"):
        before = len(left())
        rows = queries.QUERIES[f"evaluated_{name}"](spark, data).collect()
        assert rows and left() == ["evaluated-scores"] * (before + 1)
    assert queries.QUERIES["evaluated_prompt_hash"](spark, data).count() and left() == ["evaluated-retrieval"] + ["evaluated-scores"] * 5
