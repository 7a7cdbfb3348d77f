"""Providers of judged answers by name, and the structure that an answer is forced into.

A provider takes a Request and gives a Reply, or raises: JudgeUnavailable where asking again is of no use. Two kinds of public
HTTP interfaces are there; what sends a request is a parameter, so that tests and gateways can take its place."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from assay.operators.judge import JudgeUnavailable


@dataclass(frozen=True)
class Request:
    system: str
    prompt: str
    judge: dict
    schema: dict


@dataclass(frozen=True)
class Reply:
    """The structured answer, as it was parsed, and the tokens that were counted, if any."""

    content: dict
    input_tokens: int | None = None
    output_tokens: int | None = None


Provider = Callable[[Request], Reply]
Send = Callable[[str, dict, dict], dict]
_known: dict[str, Provider] = {}


def register(name: str, provider: Provider) -> None:
    _known[name] = provider


def provider(name: str) -> Provider:
    if name not in _known:
        raise JudgeUnavailable(f"no provider named {name}; there are {', '.join(sorted(_known))}")
    return _known[name]


def review_schema(judge: dict) -> dict:
    """JSON schema of a payload of reviews, with the range of scores; review_issues() checks what it can't say (names of variants, one review a query)."""
    by_variant = lambda value: {"type": "object", "minProperties": 1, "additionalProperties": value}
    score = {"type": "integer", "minimum": judge["score_min"], "maximum": judge["score_max"]}
    fields = {"query_id": {"type": "string"}, "winner": {"type": "string"}, "faithfulness": by_variant(score), "clarity": by_variant(score), "overclaim_flags": by_variant({"type": "boolean"}), "justification": {"type": "string", "minLength": 1}}
    review = {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}
    return {"type": "object", "properties": {"reviews": {"type": "array", "items": review}}, "required": ["reviews"], "additionalProperties": False}


TOOL, TOOL_SAYS = "give_reviews", "Hands in the reviews of all questions."


def _post(url: str, headers: dict, body: dict) -> dict:
    ask = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers})
    with urllib.request.urlopen(ask, timeout=300) as answer:
        return json.load(answer)


def _key(judge: dict, variable: str) -> str:
    key = os.environ.get(judge.get("key_variable", variable))
    if not key:
        raise JudgeUnavailable(f"no key in {judge.get('key_variable', variable)}")
    return key


def messages_provider(send: Send = _post, url: str = "https://api.anthropic.com/v1/messages", variable: str = "ANTHROPIC_API_KEY") -> Provider:
    """The messages interface: the answer is the input of a tool that must be used."""

    def call(request: Request) -> Reply:
        judge = request.judge
        body = {
            "model": judge["model"], "max_tokens": judge["max_tokens"], "temperature": judge["temperature"], "system": request.system, "messages": [{"role": "user", "content": request.prompt}],
            "tools": [{"name": TOOL, "description": TOOL_SAYS, "input_schema": request.schema}], "tool_choice": {"type": "tool", "name": TOOL},
        }
        said = send(url, {"x-api-key": _key(judge, variable), "anthropic-version": "2023-06-01"}, body)
        used = [b["input"] for b in said.get("content", []) if b.get("type") == "tool_use" and b.get("name") == TOOL]
        if not used:
            raise ValueError("the answer doesn't use the tool")
        usage = said.get("usage", {})
        return Reply(used[0], usage.get("input_tokens"), usage.get("output_tokens"))

    return call


def completions_provider(send: Send = _post, url: str = "https://api.openai.com/v1/chat/completions", variable: str = "OPENAI_API_KEY") -> Provider:
    """The chat-completions interface: the answer is the arguments of a function that must be called."""

    def call(request: Request) -> Reply:
        judge = request.judge
        body = {
            "model": judge["model"], "max_tokens": judge["max_tokens"], "temperature": judge["temperature"],
            "messages": [{"role": "system", "content": request.system}, {"role": "user", "content": request.prompt}],
            "tools": [{"type": "function", "function": {"name": TOOL, "description": TOOL_SAYS, "parameters": request.schema}}], "tool_choice": {"type": "function", "function": {"name": TOOL}},
        }
        said = send(url, {"authorization": f"Bearer {_key(judge, variable)}"}, body)
        calls = said["choices"][0]["message"].get("tool_calls") or []
        if not calls:
            raise ValueError("the answer doesn't call the function")
        usage = said.get("usage", {})
        return Reply(json.loads(calls[0]["function"]["arguments"]), usage.get("prompt_tokens"), usage.get("completion_tokens"))

    return call


register("anthropic", messages_provider())
register("openai", completions_provider())


def live_call(ask: Provider | None = None) -> Callable[[str, str, dict], str]:
    """What run_judge() and judge_in_batches() take as `live`: the provider that the configuration names (or `ask`), asked for the schema of reviews."""

    def live(system: str, prompt: str, judge: dict) -> str:
        reply = (ask or provider(judge["provider"]))(Request(system, prompt, judge, review_schema(judge)))
        if not isinstance(reply.content, dict):
            raise ValueError("the answer is no object")
        return json.dumps(reply.content, sort_keys=True)

    return live
