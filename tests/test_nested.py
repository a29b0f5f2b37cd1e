"""Nested content of the four formats, on files written here."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tracewell.sources import traces, written


def entries(spark, *values):
    return spark.createDataFrame([("f", i, json.dumps(v)) for i, v in enumerate(values)], "file string, ord long, entry string")


def test_tools_scores_and_wrapped_exports(spark):
    tools = [{"id": "c1", "function": {"name": "look", "arguments": '{"q": 1}'}}, {"name": "find"}, {"id": "c3"}]
    one = {"id": "o1", "type": "GENERATION", "input": {"a": 1}, "output": {"tool_calls": tools}, "totalCost": 0.5, "scores": [{"name": "good", "value": 0.5, "comment": "so"}, {"value": "none", "label": "bad"}]}
    two = {"id": "o2", "type": "SPAN", "output": "plain", "scores": []}
    wrapped = {"data": [{"id": "t1", "name": "n", "userId": "u", "tags": ["x"], "observations": [one]}, {"traceId": "t2", "observations": [two]}, {"id": "empty"}]}
    got = {r.span_id: r for r in traces.normalize(entries(spark, wrapped), "langfuse").collect()}
    assert {k: r.trace_id for k, r in got.items()} == {"o1": "t1", "o2": "t2"}
    assert [tuple(t) for t in got["o1"].tool_calls] == [("c1", "look", "function", '{"q": 1}'), (None, "find", "function", None), ("c3", "unknown", "function", None)]
    assert [tuple(t) for t in got["o1"].evaluations] == [("good", 0.5, None, "so"), ("unnamed", None, "bad", None)]
    assert got["o1"].metadata == {"name": "n", "userId": "u", "tags": '["x"]'} and got["o1"].total_cost == 0.5
    assert [tuple(m) for m in got["o1"].messages_in] == [(None, '{"a":1}')]
    assert (got["o2"].tool_calls, got["o2"].evaluations, got["o2"].messages_in, got["o2"].metadata) == (None, None, None, {})


def test_blocks_of_a_conversation(spark):
    base = {"sessionId": "S", "timestamp": "2024-01-01T00:00:00Z"}
    answer = lambda i, *blocks: base | {"type": "assistant", "uuid": f"u{i}", "message": {"type": "message", "id": f"m{i}", "content": list(blocks)}}
    use = lambda i, name, **more: {"type": "tool_use", "id": i, "name": name, "input": more}
    talk = entries(
        spark, base | {"type": "progress", "gitBranch": "main", "cwd": "/x"}, base | {"type": "user", "gitBranch": "other", "message": {"content": "[not a list]"}}, answer(1, {"type": "text", "text": "a"}, use("1", "Read", file_path="f"), {"type": "text", "text": ""}, use("2", "Edit"), {"type": "text", "text": "b"}),
        base | {"type": "user", "message": {"content": [{"type": "text", "text": "x"}, {"type": "tool_result", "content": "r"}, {"type": "text"}]}}, answer(2), base | {"type": "user", "message": {"content": [{"type": "tool_result"}]}}, answer(3), answer(4),
    )
    got = {r.span_id: r for r in traces.conversations(talk).collect()}
    pairs = lambda x: None if x is None else [tuple(m) for m in x]
    assert {k: pairs(r.messages_in) for k, r in got.items()} == {"u1": [("user", "[not a list]")], "u2": [("user", "x"), ("user", "")], "u3": None, "u4": None}
    assert pairs(got["u1"].messages_out) == [("assistant", "a"), ("assistant", "b")]
    assert pairs(got["u1"].tool_calls) == [("1", "Read", "function", '{"file_path":"f"}'), ("2", "Edit", "function", "{}")]
    assert (got["u2"].tool_calls, got["u2"].messages_out, got["u2"].response_id) == (None, None, "m2")
    assert {json.dumps(r.metadata, sort_keys=True) for r in got.values()} == {'{"cwd": "/x", "gitBranch": "main"}'}  # of the session's first entry
    assert got["u1"].start_time == got["u1"].end_time


def test_messages_and_tools_of_the_others(spark):
    raw = traces.api_log(entries(spark, {"id": "a", "request": {"temperature": 0.5, "max_tokens": 9, "messages": [{"role": "user", "content": "x"}, {"role": "tool", "content": [{"y": 1}]}]}, "response": {"id": "r"}})).first()
    assert [tuple(m) for m in raw.messages_in] == [("user", "x"), ("tool", '[{"y":1}]')] and (raw.temperature, raw.max_tokens, raw.response_id) == (0.5, 9, "r")
    kv = lambda k, v: {"key": k, "value": {"arrayValue": {"values": [{"stringValue": t} for t in v]}} if isinstance(v, list) else {"stringValue": v}}
    attributes = [kv("gen_ai.input.messages", ['{"role":"user","content":"q"}', "plain", "[1]"]), kv("gen_ai.tool.call.id", "c"), kv("gen_ai.tool.type", "function")]
    otel = traces.otel(entries(spark, {"resourceSpans": [{"scopeSpans": [{"spans": [{"spanId": "s", "attributes": attributes}, {"spanId": "none"}]}]}]})).orderBy("span_ord").collect()
    assert [tuple(m) for m in otel[0].messages_in] == [("user", "q"), (None, "plain")]
    assert [tuple(t) for t in otel[0].tool_calls] == [("c", "unknown", "function", None)]
    assert (otel[1].messages_in, otel[1].tool_calls) == (None, None)


@pytest.mark.parametrize("read", [traces.otel, traces.observations, traces.api_log, traces.conversations])
def test_no_entries(spark, read):
    assert read(spark.createDataFrame([], "file string, ord long, entry string")).count() == 0
    assert read(spark.createDataFrame([("f", 0, None)], "file string, ord long, entry string")).count() == 0


def spans_of(rows):
    kinds = "trace_id string, span_ord long, session_id string, metadata map<string, string>, start_time timestamp, input_tokens long, finish_reasons array<string>, tool_calls array<struct<id: string, name: string>>"
    return rows, kinds


def test_traces_are_written_nested_and_read_back(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 1, 2, 3, 456789)
    rows, kinds = spans_of([("t", n, "s", {"a": "b"}, at, n, ["stop"], [("i", "n")]) for n in range(1, 26)] + [("u", 1, None, None, None, None, None, None), ("u", 1, None, None, None, None, [], None), ("v", None, None, None, None, 5, None, None)])
    spans = spark.createDataFrame(rows, kinds).repartition(5)
    written.write(spans, str(tmp_path / "out"), part=10)
    found = traces.load(spark, str(tmp_path / "out"), suffixes=".json")
    back = written.read(found, spans.schema)
    assert back.columns == spans.columns
    assert sorted(map(repr, back.collect())) == sorted(map(repr, spans.collect()))
    objects = [json.loads(r.entry) for r in found.collect()]
    assert sorted((o["trace_id"], o["part"], len(o["spans"])) for o in objects) == [("t", 0, 10), ("t", 1, 10), ("t", 2, 5), ("u", 0, 2), ("v", 0, 1)]
    assert all([s["span_ord"] for s in o["spans"]] == sorted(s["span_ord"] for s in o["spans"]) and o["session_id"] == "s" and "session_id" not in o["spans"][0] for o in objects if o["trace_id"] == "t")


def test_no_spans_and_other_entries(spark, tmp_path):
    empty = spark.createDataFrame(*spans_of([]))
    written.write(empty, str(tmp_path / "none"))
    assert traces.load(spark, str(tmp_path / "none"), suffixes=".json").count() == 0
    assert written.read(entries(spark, {"what": 1}, [1], {"trace_id": "t", "spans": []}), empty.schema).count() == 0


def test_a_trace_of_a_million_spans(spark, tmp_path):
    spans = spark.range(1, 1_000_001).select(F.lit("t").alias("trace_id"), F.col("id").alias("span_ord"), F.concat(F.lit("s"), "id").alias("span_id"))
    written.write(spans, str(tmp_path / "big"))
    back = written.read(traces.load(spark, str(tmp_path / "big"), suffixes=".json"), spans.schema)
    assert back.agg(F.count("*"), F.countDistinct("span_ord"), F.sum("span_ord"), F.count_if(F.col("span_id") == F.concat(F.lit("s"), "span_ord"))).first() == (1_000_000, 1_000_000, 500_000_500_000, 1_000_000)


def test_a_trace_of_many_observations(spark):
    """Rows of observations carry none of their trace's others, which a trace of some thousands did not survive, and outputs are parsed once."""
    one = lambda i: {"id": str(i), "input": "words " * 20, "output": {"tool_calls": [{"name": f"n{i}"}]}, "scores": [{"value": i}]}
    got = traces.observations(entries(spark, {"id": "t", "name": "n", "observations": [one(i) for i in range(8000)]})).select("trace_id", "span_ord", "span_id", "tool_calls.name", "evaluations.score_value", "metadata")
    assert sorted(map(tuple, got.collect())) == sorted(("t", i + 1, str(i), [f"n{i}"], [float(i)], {"name": "n"}) for i in range(8000))
    assert got._jdf.queryExecution().optimizedPlan().toString().count(".output, ") == 1
