import json

import pytest

from tracewell.operators import coverage
from tracewell.plans import rules
from tracewell.sources import traces


def kv(key, value):
    kind = "intValue" if isinstance(value, int) else "stringValue"
    return {"key": key, "value": {"arrayValue": {"values": [{"stringValue": x} for x in value]}} if isinstance(value, list) else {kind: value}}


def span(i, parent, attributes, start=0, end=1000, **more):
    return {"traceId": "t1", "spanId": f"s{i}", "parentSpanId": parent, "startTimeUnixNano": str(1_700_000_000_000_000_000 + start * 10**6), "endTimeUnixNano": 1_700_000_000_000_000_000 + end * 10**6, "attributes": attributes, **more}


CHAT = [kv("gen_ai.operation.name", "chat"), kv("gen_ai.system", "acme"), kv("gen_ai.request.model", "m-1"), kv("gen_ai.response.model", "m-1a"), kv("gen_ai.usage.input_tokens", 500), kv("gen_ai.usage.output_tokens", 380), kv("gen_ai.response.finish_reasons", ["stop"])]


@pytest.fixture
def folder(tmp_path):
    events = [{"name": "e", "attributes": [kv("gen_ai.input.messages", ['{"role":"user"}']), kv("gen_ai.output.messages", ['{"role":"assistant"}']), kv("other", "x")]}]
    otlp = {"resourceSpans": [{"resource": {"attributes": [kv("session.id", "sess")]}, "scopeSpans": [{"spans": [
        span(1, "", CHAT, 0, 2500, events=events),
        span(2, "s1", [kv("gen_ai.operation.name", "tool_call"), kv("gen_ai.tool.name", "search"), kv("gen_ai.provider.name", "acme"), kv("crewai.task", "x")], 10, 20, status={"code": 2, "message": "no"}),
        span(3, "s1", CHAT, 30, 40),
    ]}]}]}
    (tmp_path / "a_otlp.json").write_text(json.dumps(otlp, indent=1))
    observation = [{"id": "tr", "sessionId": "q", "observations": [
        {"id": "o1", "type": "GENERATION", "providedModelName": "gpt-x", "startTime": "2024-01-01T00:00:00Z", "endTime": "2024-01-01T00:00:02Z", "inputTokens": 0, "promptTokens": 7, "level": "ERROR"},
        {"id": "o2", "type": "SPAN", "name": "Route it", "latency": 0.5, "metadata": {"agent_id": "a"}},
    ]}, {"id": "empty", "observations": []}]
    (tmp_path / "b_observations.json").write_text(json.dumps(observation))
    log = [
        {"trace_id": "r1", "timestamp": "2024-01-01T00:00:00Z", "provider": "acme", "request": {"model": "m", "messages": [{"role": "user"}]}, "response": {"id": "x", "model": "m2", "choices": [{"finish_reason": "stop"}], "usage": {"prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 7}}, "latency_ms": 12.5},
        {"trace_id": "r2", "provider": "acme", "request": {"model": "m"}, "error": {"type": "rate_limit", "message": "slow"}},
    ]
    (tmp_path / "c_log.jsonl").write_text("\n".join(map(json.dumps, log)) + "\n\nnot json\n")
    base = {"sessionId": "S", "timestamp": "2024-01-01T00:00:00Z"}
    answer = lambda i, **m: base | {"type": "assistant", "uuid": f"u{i}", "message": {"type": "message", "model": "c", "content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "Read", "input": {}}], **m}}
    talk = [base | {"type": "user", "uuid": "a", "message": {"content": "first"}}, base | {"type": "user", "uuid": "b", "message": {"content": "second"}}, answer(1, usage={"input_tokens": 5, "cache_read_input_tokens": 10, "output_tokens": 2}, stop_reason="end_turn"), answer(2), {"type": "user", "uuid": "z", "message": {"content": "no session"}}]
    (tmp_path / "d_talk.jsonl").write_text("\n".join(map(json.dumps, talk)))
    (tmp_path / "e_other.json").write_text('{"what": 1}')
    return tmp_path


def test_formats_are_told_apart(spark, folder):
    found = traces.detect(traces.load(spark, str(folder)))
    assert {r["file"].rsplit("/", 1)[1][0]: r["source_format"] for r in found.collect()} == {"a": "otel", "b": "langfuse", "c": "rawapi", "d": "claudecode", "e": "unknown"}


def test_spans_of_all_formats(spark, folder):
    spans = traces.normalize(traces.load(spark, str(folder)))
    got = {(r["trace_id"], r["span_id"]): r for r in spans.collect()}
    assert len(got) == 9
    one = got["t1", "s1"]
    assert (one["duration_ms"], one["input_tokens"], one["output_tokens"], one["finish_reasons"], one["session_id"], one["span_ord"], one["provider"], one["parent_span_id"]) == (2500.0, 500, 380, ["stop"], "sess", 1, "acme", None)
    assert one["input_messages"] == '{"role":"user"}' and one["span_kind"] == "llm_generation"
    tool = got["t1", "s2"]
    assert (tool["tool_name"], tool["span_kind"], tool["agent_framework"], tool["error_type"], tool["error_message"], tool["model_used"]) == ("search", "tool_call", "crewai", "otel_error", "no", None)
    o1, o2 = got["tr", "o1"], got["tr", "o2"]
    assert (o1["duration_ms"], o1["provider"], o1["input_tokens"], o1["error_type"], o2["duration_ms"], o2["span_kind"], o2["agent_id"]) == (2000.0, "openai", 7, "error", 500.0, "agent_handoff", "a")
    raw, failed = got["r1", "x"], next(r for k, r in got.items() if k[0] == "r2")
    assert (raw["model_used"], raw["input_tokens"], raw["total_tokens"], raw["finish_reasons"], raw["duration_ms"]) == ("m2", 3, 7, ["stop"], 12.5)
    assert (failed["error_type"], failed["error_message"], failed["input_tokens"]) == ("rate_limit", "slow", None)
    first, second = got["S", "u1"], got["S", "u2"]
    assert (first["input_messages"], first["input_tokens"], first["total_tokens"], first["finish_reasons"], first["tool_name"]) == ("second", 15, 17, ["end_turn"], "Read")
    assert (second["input_messages"], second["input_tokens"], second["span_ord"]) == (None, None, 2)


def test_audit_of_a_chat_trace(spark, folder):
    """Three spans: content is only in the events of the first, the tool's span has no model."""
    spans = traces.normalize(traces.load(spark, str(folder / "a_otlp.json")))
    covered = coverage.coverage(spans, [(f, c) for _, _, f, _, c in rules.parsed()[1]])
    scored = coverage.scored(rules.applicable(rules.requirements(spark)), rules.evidence_fields(spark), covered)
    eu = coverage.summary(scored.where("regulation = 'EU AI Act'")).first()
    assert (eu["n_rules"], eu["n_satisfied"], eu["n_partial"], eu["n_missing"]) == (36, 32, 4, 0) and round(eu["overall_score"], 6) == 0.962963
    every = coverage.summary(scored).first()
    assert (every["n_rules"], every["n_satisfied"], every["n_partial"], every["n_missing"]) == (67, 51, 14, 2)  # the second: no request parameters
    tiers = {r["tier"]: r["tier_score"] for r in coverage.tiers(scored.where("regulation = 'EU AI Act'")).collect()}
    assert tiers["deterministic"] == 1.0 and round(tiers["structural"], 6) == 0.897436
