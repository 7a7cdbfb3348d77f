"""The validator of a stored run, the command line, and the published sample's figures."""

import json
from pathlib import Path

import pytest

from assay.__main__ import main
from assay.operators.aggregate import recommendation, verdicts
from assay.operators.checks import score_answers
from assay.operators.judge import long_reviews
from assay.operators.retrieval import bm25_topk, passages
from assay.operators.taxonomy import failure_tags
from assay.plans.config import defaults
from assay.plans.pipeline import run_files
from assay.plans.stored import TYPES, artifact_paths, stored_run_issues
from assay.sources.inputs import load_inputs

CONFIG = defaults()
GOLDEN = Path(__file__).parent / "golden"
INPUTS = {n: str(GOLDEN / f"{n}.json") for n in ("kb", "queries", "answers")}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    run_files(spark, INPUTS | {"llm_calls": str(folder / "calls.jsonl")}, str(folder / "out"), CONFIG)
    return folder, load_inputs(spark, *INPUTS.values())


def found(spark, stored):
    folder, inputs = stored
    rows = stored_run_issues(spark, inputs, artifact_paths(str(folder / "out"), str(folder / "calls.jsonl")), CONFIG).collect()
    return sorted((r.code, r.location.replace(str(folder), "")) for r in rows)


def test_a_run_holds(spark, stored):
    assert found(spark, stored) == []


def _record(name, change):
    def do(out):
        rows = json.loads((out / name).read_text())
        change(rows)
        (out / name).write_text(json.dumps(rows))

    return name, do


def _file(name, text):
    return name, lambda out: (out / name).unlink() if text is None else (out / name).write_text(text)


@pytest.mark.parametrize(
    ("faults", "want"),
    [
        (
            [_file("retrieval.json", None), _file("automated_scores.json", "{}"), _file("review_report.md", " \n"), _file("recommendation.md", None), _file("run_manifest.json", "x"), _file("../calls.jsonl", '{"a": 1}\n\nno\n[]\n')],
            ["EMPTY_ARTIFACT /out/review_report.md", "INVALID_JSON /calls.jsonl:3", "INVALID_JSON /calls.jsonl:4", "INVALID_JSON /out/run_manifest.json", "MISSING_ARTIFACT /out/recommendation.md", "MISSING_ARTIFACT /out/retrieval.json", "NOT_AN_ARRAY /out/automated_scores.json"],
        ),
        (
            [_file("retrieval.json", "{"), _file("automated_scores.json", "[]"), _file("run_manifest.json", None), _record("failure_taxonomy.json", lambda r: r.extend([3, {"query_id": "Q1", "variant": 3}]))],
            ["EMPTY_ARTIFACT /out/automated_scores.json", "INVALID_JSON /out/retrieval.json", "MISSING_ARTIFACT /out/run_manifest.json", "NOT_AN_OBJECT /out/failure_taxonomy.json[8]", "SCHEMA_INVALID /out/failure_taxonomy.json[9].tags", "SCHEMA_INVALID /out/failure_taxonomy.json[9].variant"],
        ),
        ([_file("recommendation.md", "another"), _record("retrieval.json", lambda r: (r.pop(0), r[0]["retrieved"].pop()))], ["MISSING_RETRIEVAL Q1", "RECOMMENDATION_NOT_REPRODUCIBLE /out/recommendation.md", "WRONG_RETRIEVAL_COUNT Q2"]),
        ([_file("run_manifest.json", "{}")], ["MANIFEST_UNREADABLE /out/run_manifest.json"]),
    ],
)
def test_faults(spark, stored, faults, want):
    out = stored[0] / "out"
    before = {name: (out / name).read_text() for name, _ in faults}
    try:
        for _, do in faults:
            do(out)
        assert [" ".join(x) for x in found(spark, stored)] == want
    finally:
        for name, text in before.items():
            (out / name).write_text(text)


def test_scores_and_reviews_of_a_stored_run(spark, stored):
    out = stored[0] / "out"
    before = {n: (out / n).read_text() for n in ("automated_scores.json", "llm_review.json")}
    try:
        scores, reviews = (json.loads(before[n]) for n in before)
        lost = scores.pop(2)
        reviews[1]["clarity"] = {k: 9 for k in reviews[1]["clarity"]}
        (out / "automated_scores.json").write_text(json.dumps(scores))
        (out / "llm_review.json").write_text(json.dumps(reviews))
        got = found(spark, stored)
        assert ("UNPROCESSED_ANSWER", f"{lost['query_id']}/{lost['variant']}") in got
        assert got.count(("INVALID_LLM_REVIEW", "/out/llm_review.json")) == 2  # the score, and so no valid review
    finally:
        for n, text in before.items():
            (out / n).write_text(text)


def test_command_line(spark, tmp_path, capsys):
    given = [x for n, p in INPUTS.items() for x in (f"--{n}", p)] + ["--out", str(tmp_path / "o"), "--llm-calls", str(tmp_path / "c.jsonl")]
    assert main(["run", *given], spark) == 0 and "selected variant: prompt_a" in capsys.readouterr().out
    (tmp_path / "o" / "retrieval.json").unlink()
    assert main(["validate", *given], spark) == 1 and "MISSING_ARTIFACT" in capsys.readouterr().err
    assert main(["run", *given, "--kb", str(tmp_path / "none.json")], spark) == 1 and "FILE_NOT_FOUND" in capsys.readouterr().err
    assert main(["run", "--config", str(tmp_path / "none.yaml")], spark) == 1


def test_published_figures(spark):
    inputs = load_inputs(spark, *INPUTS.values())
    top = bm25_topk(inputs.kb, inputs.queries, CONFIG["retrieval"])
    assert {(r.query_id, r.rank): (r.doc_id, r.score) for r in top.collect()} == {
        ("Q1", 1): ("D2", 4.8189), ("Q1", 2): ("D1", 1.1557), ("Q2", 1): ("D1", 2.9253), ("Q2", 2): ("D4", 0.6507),
        ("Q3", 1): ("D3", 6.1915), ("Q3", 2): ("D1", 0.0), ("Q4", 1): ("D4", 3.6826), ("Q4", 2): ("D1", 1.1557),
    }
    scores = score_answers(inputs.queries, inputs.answers, passages(top, inputs.kb, inputs.queries), CONFIG).persist()
    assert {(r.query_id, r.variant[-1]): r.grounding_score for r in scores.collect()} == {
        ("Q1", "a"): 0.75, ("Q1", "b"): 0.51, ("Q2", "a"): 0.6679, ("Q2", "b"): 0.2833, ("Q3", "a"): 0.8867, ("Q3", "b"): 0.2833, ("Q4", "a"): 0.9227, ("Q4", "b"): 0.2429,
    }
    reviews = long_reviews(spark.createDataFrame(json.loads((GOLDEN / "reviews.json").read_text()), TYPES["llm_review"]))
    tags = failure_tags(scores, inputs.queries, inputs.answers, reviews, CONFIG)
    verdict = verdicts(scores, inputs.queries, reviews, tags, CONFIG)
    rows = {r.variant: r for r in verdict.collect()}
    assert (rows["prompt_a"].composite_score, rows["prompt_b"].composite_score) == (0.9614, 0.3004)
    assert rows["prompt_b"].disqualified and len(rows["prompt_b"].reasons) == 2 and not rows["prompt_a"].disqualified
    assert recommendation(verdict, CONFIG).first().selected_variant == "prompt_a"
