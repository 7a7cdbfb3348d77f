import json
import math

import pytest
from pyspark.sql import functions as F

from assay.functions.grounding import with_evidence, with_grounding
from assay.functions.text import tokens
from assay.operators import validate
from assay.operators.aggregate import recommendation, tradeoffs, verdicts
from assay.operators.checks import score_answers
from assay.operators.judge import JudgeUnavailable, long_reviews, review_entry_issues, review_issues, run_judge, stub_reviews, wide_reviews
from assay.operators.retrieval import bm25_topk, passages
from assay.operators.taxonomy import failure_tags
from assay.plans.config import ConfigError, config_hash, defaults, load_config
from assay.plans.pipeline import recommendation_markdown, run_files, run_issues
from assay.sources.artifacts import append_call_log, read_call_log
from assay.sources.inputs import InputError, load_inputs

CONFIG = defaults()
KB = [
    {"doc_id": "A1", "title": "Opening hours", "text": "The library opens at 9 on weekdays and closes at 18. On Sundays it stays closed."},
    {"doc_id": "A2", "title": "Loans", "text": "Books may be kept for 28 days. A loan can be renewed twice unless another reader waits."},
    {"doc_id": "A3", "title": "", "text": "Rooms are booked at the desk."},
]
QUERIES = [
    {"query_id": "R1", "user_question": "How long may books be kept on loan?", "expected_doc_ids": ["A2"], "must_include_any": ["28 days", " "], "must_not_claim": ["kept forever", "always renewed"], "risk_level": "high"},
    {"query_id": "R2", "user_question": "When does the library open?", "risk_level": "low"},
    {"query_id": "R3", "user_question": "zzz", "expected_doc_ids": ["A3"], "must_include_any": ["desk"], "must_not_claim": [], "risk_level": "odd"},
]
ANSWERS = [
    {"query_id": "R1", "answers": {"plain": "Books may be kept for 28 days.", "bold": "They can be kept forever, always renewed for 99 days."}},
    {"query_id": "R2", "answers": {"plain": "It opens at 9 on weekdays.", "bold": "At 7."}},
    {"query_id": "R3", "answers": {"plain": "Ask at the desk.", "bold": ""}},
]


@pytest.fixture
def files(tmp_path):
    def write(kb=KB, queries=QUERIES, answers=ANSWERS):
        paths = {}
        for name, rows in (("kb", kb), ("queries", queries), ("answers", answers)):
            paths[name] = str(tmp_path / f"{name}.json")
            (tmp_path / f"{name}.json").write_text(rows if isinstance(rows, str) else json.dumps(rows))
        return paths

    return write


def codes(spark, paths):
    with pytest.raises(InputError) as error:
        load_inputs(spark, paths["kb"], paths["queries"], paths["answers"])
    return {r.code for r in error.value.issues}


def test_bm25_by_hand(spark):
    kb = spark.createDataFrame([("D10", "", "red fox"), ("D2", "", "red red hen"), ("D3", "", "blue sky")], "doc_id string, title string, text string")
    q = spark.createDataFrame([("q", "red"), ("none", "green")], "query_id string, user_question string")
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in bm25_topk(kb, q, CONFIG["retrieval"]).collect()}
    idf, avg = math.log(1 + (3 - 2 + 0.5) / 2.5), 7 / 3

    def score(tf, n):
        return round(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg)), 4)

    assert got["q", 1] == ("D2", score(2, 3))
    assert got["q", 2] == ("D10", score(1, 2))
    assert [got["none", k] for k in (1, 2)] == [("D10", 0.0), ("D2", 0.0)]  # zero scores fill up by id as text


def test_bm25_repeated_query_terms_and_empty_tables(spark):
    kb = spark.createDataFrame([("a", None, "fox hen"), ("b", "fox", None)], "doc_id string, title string, text string")
    q = spark.createDataFrame([("once", "fox"), ("twice", "fox fox"), ("null", None)], "query_id string, user_question string")
    got = {(r.query_id, r.doc_id): r.score for r in bm25_topk(kb, q, CONFIG["retrieval"]).collect()}
    assert got["twice", "b"] == pytest.approx(2 * got["once", "b"], abs=2e-4)
    assert got["null", "a"] == 0
    assert bm25_topk(kb.limit(0), q, CONFIG["retrieval"]).count() == 0
    assert bm25_topk(kb, q.limit(0), CONFIG["retrieval"]).count() == 0


def test_pruned_retrieval_is_the_same(spark, monkeypatch):
    import random

    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=n))
    kb = spark.createDataFrame([(str(i), None, text(rng.randint(1, 40))) for i in range(300)], "doc_id string, title string, text string")
    queries = spark.createDataFrame([(f"q{i}", text(rng.randint(0, 12))) for i in range(30)], "query_id string, user_question string")
    rows = lambda: sorted(map(tuple, bm25_topk(kb, queries, CONFIG["retrieval"] | {"top_k": 3}).collect()))
    whole = rows()
    monkeypatch.setattr("assay.operators.retrieval.PRUNE_FROM", 0)
    assert rows() == whole and len(whole) == 90


@pytest.mark.parametrize(
    ("answer", "evidence", "precision", "quote", "lost", "score"),
    [
        ("kept for 28 days", "Books are kept for 28 days here", 1.0, True, [], 1.0), ("green apples", "red pears", 0.0, False, [], 0.0), ("", "x", 0.0, False, [], 0.0),
        ("kept 28 apples", "kept for 28 days", 0.6667, False, [], 0.5667), ("costs 99", "costs little", 0.5, False, ["99"], 0.175), ("5", "15", 0.0, False, [], 0.0), ("24, hours", "24 hours", 1.0, False, ["24,"], 0.6),
    ],
)
def test_grounding(spark, answer, evidence, precision, quote, lost, score):
    passage = "array<struct<doc_id:string,score:double,title:string,text:string>>"
    df = spark.createDataFrame([(answer, [("d", 1.0, None, evidence)])], f"answer string, retrieved {passage}")
    g = with_grounding(with_evidence(df).withColumn("words", tokens(F.col("answer"))), CONFIG["grounding"]).first()
    assert (g.precision, g.quote, g.unsupported, g.grounding_score) == (precision, quote, lost, pytest.approx(score, abs=1e-4))


def test_scores_flags_and_notes(spark, files):
    paths = files()
    inputs = load_inputs(spark, paths["kb"], paths["queries"], paths["answers"])
    retrieval = passages(bm25_topk(inputs.kb, inputs.queries, CONFIG["retrieval"]), inputs.kb, inputs.queries)
    rows = {(r.query_id, r.variant): r for r in score_answers(inputs.queries, inputs.answers, retrieval, CONFIG).collect()}
    plain, bold = rows["R1", "plain"], rows["R1", "bold"]
    assert plain.risk_flags == ["none"] and plain.retrieval_hit and plain.must_include_pass
    assert plain.notes.startswith("must_include: matched '28 days' (via exact); must_not_claim: clean; grounding: precision=1.0, quote_span=True, unsupported_numbers=none")
    assert bold.risk_flags == ["missing_required_phrase", "must_not_claim_violation", "unsupported_numeric", "low_grounding"]
    assert "VIOLATED 'kept forever' (via exact), 'always renewed' (via exact)" in bold.notes and "unsupported_numbers=['99']" in bold.notes
    assert "must_include: n/a (no constraints)" in rows["R2", "plain"].notes and rows["R2", "plain"].must_not_claim_pass
    assert rows["R3", "bold"].risk_flags == ["retrieval_miss", "missing_required_phrase", "low_grounding"]


def test_tags(spark):
    scores = spark.createDataFrame([("q", "v", False, False, False, 0.1, ["x"])], "query_id string, variant string, retrieval_hit boolean, must_include_pass boolean, must_not_claim_pass boolean, grounding_score double, risk_flags array<string>")
    queries = spark.createDataFrame([("q", "unheard of")], "query_id string, risk_level string")
    answers = spark.createDataFrame([("q", "v", "Always.")], "query_id string, variant string, answer string")
    none = spark.createDataFrame([], "query_id string, variant string, overclaim boolean")
    assert failure_tags(scores, queries, answers, none, CONFIG).first().tags == ["unsupported_claim", "missed_key_fact", "policy_violation", "retrieval_miss", "overconfident_tone", "irrelevant_answer"]
    fine = scores.selectExpr("query_id", "variant", "true AS retrieval_hit", "true AS must_include_pass", "true AS must_not_claim_pass", "0.9D AS grounding_score", "risk_flags")
    assert failure_tags(fine, queries, answers, none, CONFIG).first().tags == []
    over = spark.createDataFrame([("q", "v", True)], "query_id string, variant string, overclaim boolean")
    assert failure_tags(fine, queries, answers.limit(0), over, CONFIG).first().tags == ["unsupported_claim"]


SCORE = "query_id string, variant string, retrieval_hit boolean, must_include_pass boolean, must_not_claim_pass boolean, grounding_score double, risk_flags array<string>"


def decide(spark, rows, risk="high", reviews=()):
    scores = spark.createDataFrame([("q", v, True, True, clean, g, ["none"]) for v, clean, g in rows], SCORE)
    queries = spark.createDataFrame([("q", 0, risk)], "query_id string, q_ord int, risk_level string")
    reviews = spark.createDataFrame(list(reviews), "query_id string, variant string, faithfulness int, clarity int, winner string")
    tags = spark.createDataFrame([("q", v, ["missed_key_fact"]) for v, _, _ in rows], "query_id string, variant string, tags array<string>")
    verdict = verdicts(scores, queries, reviews, tags, CONFIG)
    decided = recommendation(verdict, CONFIG)
    return {r.variant: r for r in verdict.collect()}, decided.first(), tradeoffs(verdict, decided).collect()


def test_gate_and_margin(spark):
    verdict, one, _ = decide(spark, [("a", True, 0.9), ("b", False, 1.0)])
    assert one.selected_variant == "a" and one.n_candidates == 1 and verdict["b"].disqualified and "risk high" in verdict["b"].reasons[0]
    assert verdict["a"].failure_tag_counts == {"missed_key_fact": 1} and verdict["a"].mean_clarity is None
    verdict, one, _ = decide(spark, [("a", True, 0.9), ("b", False, 1.0)], risk="medium")
    assert not verdict["b"].disqualified and one.selected_variant == "a" and one.n_candidates == 2
    _, one, _ = decide(spark, [("a", True, 0.90), ("b", True, 0.91)])
    assert one.selected_variant is None and one.margin == pytest.approx(0.002)
    _, one, _ = decide(spark, [("a", False, 0.9)])
    assert one.selected_variant is None and one.n_candidates == 0
    _, one, _ = decide(spark, [("a", True, 0.1), ("b", True, 0.9), ("c", True, 0.5)])
    assert (one.selected_variant, one.runner_up) == ("b", "c")


def test_tradeoff_and_reviews(spark):
    reviews = [("q", "a", 5, 2, "a"), ("q", "b", 1, 5, "a")]
    verdict, _, trade = decide(spark, [("a", True, 0.9), ("b", False, 1.0)], reviews=reviews)
    assert [(r.variant, r.target, r.mean_clarity, r.target_clarity) for r in trade] == [("b", "a", 5.0, 2.0)]
    assert verdict["a"].judge_wins == 1 and verdict["a"].composite_score == pytest.approx(0.1 + 0.2 + 0.25 + 0.18 + 0.15 + 0.0125 + 0.05, abs=1e-4)


def test_stub(spark):
    answers = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c"), ("r", "z"), ("r", "y")], "query_id string, variant string")
    scores = spark.createDataFrame([("q", "a", True, True, True, 0.375, ["none"]), ("q", "b", True, True, True, 0.625, ["unsupported_numeric"])], SCORE)
    rows = {(r.query_id, r.variant): r for r in stub_reviews(answers, scores, CONFIG["judge"]).collect()}
    assert [rows["q", v].faithfulness for v in "abc"] == [2, 4, 1]  # 2.5 and 3.5 go to the even neighbour
    assert [rows["q", v].overclaim for v in "abc"] == [False, True, True] and rows["q", "a"].clarity == 3 and rows["q", "c"].clarity == 1
    assert rows["q", "a"].winner == "b" and rows["r", "z"].winner == "y"
    assert long_reviews(wide_reviews(stub_reviews(answers, scores, CONFIG["judge"]))).count() == 5


def good(**changes):
    entry = {"query_id": "q", "winner": "a", "faithfulness": {"a": 3, "b": 5}, "clarity": {"a": 1, "b": 2}, "overclaim_flags": {"a": False, "b": True}, "justification": "fits"}
    return entry | changes


@pytest.mark.parametrize(
    ("payload", "want"),
    [
        ({"reviews": [good()]}, []), ([], ["no object", "no valid"]), ("nope", ["no object", "no valid"]), ({"reviews": {}}, ["no object", "no valid"]), ({"reviews": [1, good()]}, ["no object"]), ({"reviews": []}, ["no valid review"]),
        ({"reviews": [good(query_id="x"), good()]}, ["unknown query_id"]), ({"reviews": [good(), good()]}, ["second review"]), ({"reviews": [good(winner="c")]}, ["winner", "no valid"]),
        ({"reviews": [good(faithfulness={"a": 3})]}, ["faithfulness must have", "no valid"]), ({"reviews": [good(clarity={"a": True, "b": 2})]}, ["clarity must be whole", "no valid"]),
        ({"reviews": [good(clarity={"a": 6, "b": 2})]}, ["clarity must be whole", "no valid"]), ({"reviews": [good(overclaim_flags={"a": 0, "b": True})]}, ["overclaim_flags must be true", "no valid"]), ({"reviews": [good(justification="  ")]}, ["justification", "no valid"]),
    ],
)
def test_review_issues(spark, payload, want):
    queries = spark.createDataFrame([("q",)], "query_id string")
    answers = spark.createDataFrame([("q", "b"), ("q", "a")], "query_id string, variant string")
    text = payload if isinstance(payload, str) else json.dumps(payload)
    got = sorted(r.problem for r in review_issues(spark.createDataFrame([(text,)], "response string"), queries, answers, 1, 5).collect())
    assert len(got) == len(want)
    assert all(any(g.startswith(w) for g in got) for w in want)


def test_reviews_as_a_table(spark):
    """One row a review gives the same issues as the list of all in one payload; the first by position counts."""
    queries = spark.createDataFrame([("q",), ("r",), ("s",)], "query_id string")
    answers = spark.createDataFrame([(q, v) for q in "qrs" for v in "ab"], "query_id string, variant string")
    reviews = [good(query_id="r", clarity={"a": 1}), 1, good(), good(winner="b"), good(query_id="x"), good(query_id="x"), good(query_id=None)]
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(reviews)] + [(9, "{")], "pos int, entry string").repartition(3)
    got = sorted((r.query_id or "", r.problem) for r in review_entry_issues(rows, queries, answers, 1, 5).collect())
    want = [("", "no object"), ("", "no object"), ("", "unknown query_id"), ("q", "second review"), ("r", "clarity must have the variants as keys"), ("r", "no valid review"), ("s", "no valid review"), ("x", "unknown query_id"), ("x", "unknown query_id")]
    assert got == want
    whole = spark.createDataFrame([(json.dumps({"reviews": reviews}),)], "response string")
    assert sorted((r.query_id or "", r.problem) for r in review_issues(whole, queries, answers, 1, 5).collect()) == want[1:]


@pytest.fixture
def judged(spark):
    queries = spark.createDataFrame([("q", 0, "why?", "low")], "query_id string, q_ord int, user_question string, risk_level string")
    answers = spark.createDataFrame([("q", "a", "so"), ("q", "b", "thus")], "query_id string, variant string, answer string")
    retrieval = spark.createDataFrame([("q", [("d", 1.0, "t", "x")])], "query_id string, retrieved array<struct<doc_id:string,score:double,title:string,text:string>>")
    scores = spark.createDataFrame([("q", v, True, True, True, 0.5, ["none"]) for v in "ab"], SCORE)
    return queries, answers, retrieval, scores


def test_judge_backends(spark, judged, tmp_path):
    asked = []

    def live(system, prompt, judge):
        asked.append(prompt)
        return json.dumps({"reviews": [good()] if len(asked) > 1 else []})

    path = str(tmp_path / "calls.jsonl")
    reviews, backend, calls = run_judge(*judged, CONFIG, read_call_log(spark, path), live)
    assert backend == "live" and reviews.first().winner == "a" and [c["parsed_ok"] for c in calls] == [False, True] and "no valid review" in asked[1]
    append_call_log(path, calls)
    append_call_log(path, [])
    with open(path, "a") as log:
        log.write("broken\n")
    reviews, backend, calls = run_judge(*judged, CONFIG, read_call_log(spark, path), live)
    assert backend == "cache" and len(asked) == 2 and calls[0]["replayed_call_id"]
    other = defaults()
    other["judge"]["provider"] = "another"
    _, backend, _ = run_judge(*judged, other, read_call_log(spark, path), None)
    assert backend == "stub"


def test_judge_gives_up(spark, judged):
    def off(*_):
        raise JudgeUnavailable("no key")

    config = defaults()
    config["judge"]["backend_order"] = ["live"]
    with pytest.raises(RuntimeError, match="no key"):
        run_judge(*judged, config, None, off)


def test_end_to_end(spark, files, tmp_path):
    paths = files() | {"llm_calls": str(tmp_path / "log.jsonl")}
    run = run_files(spark, paths, str(tmp_path / "out"), CONFIG)
    first = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir() if p.name != "run_manifest.json"}
    assert run.backend == "stub" and run.decision.first().selected_variant == "plain"
    assert json.loads(first["automated_scores.json"])[0]["query_id"] == "R1" and [x["variant"] for x in json.loads(first["failure_taxonomy.json"])[:2]] == ["plain", "bold"]
    assert run_issues(run, CONFIG).count() == 0 and "bold is out" in recommendation_markdown(run)
    again = run_files(spark, paths, str(tmp_path / "out"), CONFIG)
    assert first == {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir() if p.name != "run_manifest.json"}
    assert validate.differences(run.scores, again.scores).count() == 0


@pytest.mark.parametrize(
    ("changes", "code"),
    [
        ({"kb": "{"}, "INVALID_JSON"), ({"kb": {"a": 1}}, "NOT_AN_ARRAY"), ({"kb": [1, *KB]}, "NOT_AN_OBJECT"), ({"kb": [*KB, KB[0]]}, "DUPLICATE_ID"), ({"kb": []}, "EMPTY_KB"), ({"queries": []}, "EMPTY_QUERIES"), ({"answers": []}, "EMPTY_ANSWERS"),
        ({"queries": [{"query_id": "R1", "user_question": "x"}, *QUERIES[1:]]}, "SCHEMA_INVALID"), ({"queries": [QUERIES[0] | {"expected_doc_ids": ["A9"]}, *QUERIES[1:]]}, "DANGLING_DOC_ID"),
        ({"answers": [*ANSWERS, {"query_id": "R9", "answers": {"plain": "x"}}]}, "DANGLING_QUERY_ID"), ({"answers": [{"query_id": "R1", "answers": {}}, *ANSWERS[1:]]}, "SCHEMA_INVALID"), ({"answers": [{"query_id": "R1", "answers": {"plain": 3}}, *ANSWERS[1:]]}, "SCHEMA_INVALID"),
    ],
)
def test_input_errors(spark, files, changes, code):
    assert code in codes(spark, files(**changes))


def test_missing_file_and_warnings(spark, files, tmp_path):
    paths = files(answers=[ANSWERS[0], {"query_id": "R2", "answers": {"plain": ""}}])
    assert "FILE_NOT_FOUND" in codes(spark, paths | {"kb": str(tmp_path / "none.json")})
    inputs = load_inputs(spark, paths["kb"], paths["queries"], paths["answers"])
    assert {(r.code, r.severity) for r in inputs.issues.collect()} == {("MISSING_ANSWERS", "WARNING"), ("INCONSISTENT_VARIANTS", "WARNING")}
    assert [r.must_include_any for r in inputs.queries.orderBy("q_ord").collect()][:2] == [["28 days"], []]


def test_config(tmp_path):
    import yaml

    (tmp_path / "c.yaml").write_text(yaml.safe_dump(defaults()))
    assert config_hash(load_config(str(tmp_path / "c.yaml"))) == config_hash(defaults())
    (tmp_path / "d.yaml").write_text("judge: {}")
    for name in ("d.yaml", "none.yaml"):
        with pytest.raises(ConfigError):
            load_config(str(tmp_path / name))
