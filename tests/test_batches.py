"""Batches of reviews: packing, replay, live calls of the rest, repair, and providers by name."""

import json

import pytest
from pyspark.sql import functions as F

from assay.operators.batches import judge_in_batches, prompt_batches
from assay.operators.judge import JudgeUnavailable, build_prompt
from assay.operators.providers import Reply, Request, completions_provider, live_call, messages_provider, provider, register, review_schema
from assay.plans.config import defaults

N = 24


@pytest.fixture(scope="module")
def tables(spark):
    queries = spark.createDataFrame([(f"q{i}", i, f"what of {i}?", "low") for i in range(N)], "query_id string, q_ord long, user_question string, risk_level string")
    answers = spark.createDataFrame([(f"q{i}", v, f"answer {v} {i} " + "x" * (40 * (i % 5))) for i in range(N) for v in ("a", "b")], "query_id string, variant string, answer string")
    retrieval = spark.createDataFrame([], "query_id string, retrieved array<struct<doc_id:string,score:double,title:string,text:string>>")
    scores = spark.createDataFrame([(f"q{i}", v, True, True, True, 0.5 if v == "a" else 0.75, ["none"]) for i in range(N) for v in ("a", "b")], "query_id string, variant string, retrieval_hit boolean, must_include_pass boolean, must_not_claim_pass boolean, grounding_score double, risk_flags array<string>")
    return queries, answers, retrieval, scores


def payloads():
    """What gives a valid answer to all questions of a prompt; made here, so that tasks get it by value."""

    def payload(prompt, winner="a"):
        ids = [line.split("query=")[1].rstrip(">") for line in prompt.split("\n") if line.startswith("<item query=")]
        both = lambda v: {"a": v, "b": v}
        return json.dumps({"reviews": [{"query_id": q, "winner": winner, "faithfulness": both(4), "clarity": both(3), "overclaim_flags": both(False), "justification": " fits "} for q in ids]})

    return payload


def test_prompts_hold_all_blocks_in_order(spark, tables):
    blocks = build_prompt(*tables)
    prompts, members = prompt_batches(blocks, defaults()["judge"], 120)
    got = [r for r in prompts.orderBy("batch").collect()]
    assert len(got) > 3 and sum(r.n for r in got) == N
    assert "\n".join(r.prompt for r in got) == "\n".join(r.block for r in blocks.orderBy("q_ord").collect())
    most = max(len(r.block) for r in blocks.collect())
    assert all(len(r.prompt) <= 4 * (120 + 1) + most + r.n for r in got)
    assert members.count() == N
    again = {r.batch: r.prompt_hash for r in prompt_batches(blocks.repartition(3), defaults()["judge"], 120)[0].collect()}
    assert again == {r.batch: r.prompt_hash for r in got}


def test_cache_live_repair_and_stub(spark, tables):
    config = defaults()
    config["judge"]["max_retries"] = 1
    payload = payloads()
    prompts = prompt_batches(build_prompt(*tables), config["judge"], 120)[0].orderBy("batch").collect()
    good, bad = prompts[0], prompts[1]
    entries = [(1, "live", True, good.prompt_hash, "c1", payload(good.prompt, "b")), (2, "live", True, bad.prompt_hash, "c2", payload(bad.prompt) + " and more"), (3, "cache", True, prompts[2].prompt_hash, "c3", payload(prompts[2].prompt))]
    log = spark.createDataFrame(entries, "line long, backend string, parsed_ok boolean, prompt_hash string, call_id string, response_raw string")
    gone, once = prompts[3].prompt, prompts[4].prompt

    def live(system, prompt, judge):
        if prompt.startswith(gone):
            raise JudgeUnavailable("no key")
        if prompt == once:
            return payload(prompt).replace('"a": 4', '"a": 9', 1)
        if prompt.startswith(once):
            assert "must be whole numbers" in prompt
        return payload(prompt)

    out = judge_in_batches(*tables, config, log, live, 120)
    of = {r.batch: r.backend for r in out.reviews.select("batch", "backend").distinct().collect()}
    want = {r.batch: "live" for r in prompts} | {good.batch: "cache", prompts[3].batch: "stub"}
    assert of == want
    assert out.reviews.count() == N and out.reviews.where("justification <> trim(justification)").count() == 0
    winners = {r.query_id: r.winner for r in out.reviews.where(F.col("batch") == good.batch).collect()}
    assert set(winners.values()) == {"b"}
    tries = [(r.backend, r.parsed_ok) for r in out.calls.where(F.col("batch") == prompts[4].batch).collect()]
    assert sorted(tries) == [("live", False), ("live", True)]
    replay = out.calls.where("backend = 'cache'").collect()
    assert {(r.batch, r.parsed_ok, r.replayed_call_id) for r in replay} == {(good.batch, True, "c1"), (bad.batch, False, "c2")}


def test_no_backend_is_an_error(spark, tables):
    config = defaults()
    config["judge"]["backend_order"] = ["cache", "live"]
    with pytest.raises(RuntimeError, match="batches"):
        judge_in_batches(*tables, config, None, lambda s, p, j: "nothing", 10_000)


def test_providers(monkeypatch):
    judge, seen = defaults()["judge"], []
    answer = {"reviews": []}

    def send(url, headers, body):
        seen.append((url, headers, body))
        if "anthropic" in url:
            return {"content": [{"type": "text", "text": "x"}, {"type": "tool_use", "name": body["tool_choice"]["name"], "input": answer}], "usage": {"input_tokens": 3, "output_tokens": 4}}
        return {"choices": [{"message": {"tool_calls": [{"function": {"arguments": json.dumps(answer)}}]}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}}

    request = Request("s", "p", judge, review_schema(judge))
    for make, variable in ((messages_provider, "ANTHROPIC_API_KEY"), (completions_provider, "OPENAI_API_KEY")):
        monkeypatch.delenv(variable, raising=False)
        with pytest.raises(JudgeUnavailable):
            make(send)(request)
        monkeypatch.setenv(variable, "k")
        assert make(send)(request) == Reply(answer, 3, 4)
        assert make(send, variable="OTHER") and seen[-1][2]["tool_choice"]
        with pytest.raises(ValueError):
            make(lambda *a: {"content": [], "choices": [{"message": {}}]})(request)
    with pytest.raises(JudgeUnavailable):
        provider("nobody")
    register("local", lambda r: Reply({"reviews": [r.prompt, r.schema["required"]]}))
    assert json.loads(live_call()("s", "p", judge | {"provider": "local"})) == {"reviews": ["p", ["reviews"]]}
    with pytest.raises(ValueError):
        live_call(lambda r: Reply([]))("s", "p", judge)


def test_evaluation_in_batches(spark, tables):
    """The whole evaluation by batches decides as by one call, as both end with the stub."""
    from assay.plans.pipeline import evaluate
    from assay.sources.inputs import Inputs

    queries = tables[0].withColumns({c: F.array().cast("array<string>") for c in ("expected_doc_ids", "must_include_any", "must_not_claim")})
    answers = tables[1].withColumns({"a_ord": F.substring("query_id", 2, 9).cast("long"), "v_pos": F.lit(0)})
    kb = spark.createDataFrame([("d1", "t", "answer a 3 what of 3"), ("d2", "t", "else")], "doc_id string, title string, text string")
    inputs = Inputs(kb, queries, answers, None)
    one, many = evaluate(inputs, defaults()), evaluate(inputs, defaults(), batch_tokens=300)
    assert one.decision.first() == many.decision.first() and many.backend == "stub"
    assert many.batch_calls.count() > 1 and one.batch_calls is None
    assert sorted(map(str, one.reviews.collect())) == sorted(map(str, many.reviews.select(*one.reviews.columns).collect()))


def test_replayed_batches_are_made_once(spark, monkeypatch):
    """The query makes its prompts once, for the log and the reviews, and reads answers and scores that are written; hits are written before they are checked."""
    from assay.operators import batches
    from assay.plans import queries

    calls, names = [], []
    make, judged, keep = batches.prompt_batches, queries.judge_in_batches, batches.kept
    for module in (batches, queries):
        monkeypatch.setattr(module, "prompt_batches", lambda *a: calls.append("prompts") or make(*a))
    monkeypatch.setattr(batches, "kept", lambda table, name: names.append(name) or keep(table, name))

    def judge(chats, answers, retrieval, scores, *more):
        calls.extend(t._jdf.queryExecution().optimizedPlan().toString().count("Join") for t in (answers, scores))
        return judged(chats, answers, retrieval, scores, *more)

    monkeypatch.setattr(queries, "judge_in_batches", judge)
    rows = queries.judge_batches_replayed(queries.Tables(spark, "/root/testdata/sf0.001")).collect()
    assert rows and calls == ["prompts", 0, 0] and names.count("cache-hits") == 1
