"""Sessions with user turns and with debug logs beside them, on small tables."""

import datetime as dt

from tracewell.operators import logs
from tracewell.operators import sessions as ses

CALLS = "session_id string, ord long, ts timestamp, day string, input_tokens long, output_tokens long, cache_read long, cache_create long, model string, stop_reason string, tool string, file string"


def at(minute):
    return dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=minute)


def call(session, ord, minute, tool=None, file=None, i=1000, o=10):
    return (session, ord, at(minute), "2024-01-01", i, o, 0, 0, "m", "end_turn", tool, file)


def test_turns_count_for_corrections_and_length(spark):
    calls = spark.createDataFrame([call("a", 1, 10), call("a", 2, 20), call("b", 1, 5)], CALLS)
    turns = spark.createDataFrame([("a", at(0), "revert that"), ("a", at(15), "go on"), ("a", at(50), "  "), ("a", at(51), None), ("c", at(1), "undo that")], "session_id string, ts timestamp, prompt string")
    got = {r.session_id: r for r in ses.efficiency(calls, turns).collect()}
    assert set(got) == {"a", "b"}  # a session of turns alone has no call
    assert (got["a"].corrections, got["a"].correction_rate) == (1, 0.5)  # blank and null turns say nothing
    assert got["a"].duration_hours == round(51 / 60, 6)
    assert (got["b"].corrections, got["b"].correction_rate, got["b"].duration_hours) == (0, 0.0, 0.0)


def test_empty_tables(spark):
    calls, turns = spark.createDataFrame([], CALLS), spark.createDataFrame([], "session_id string, ts timestamp, prompt string")
    sessions = ses.efficiency(calls, turns)
    assert sessions.count() == 0
    buckets = ses.length_buckets(sessions)
    assert ses.optimal_length(buckets).first().optimal_length == "Not enough data"
    assert [r.advice for r in ses.workflow_advice(sessions, ses.file_churn(calls), ses.prompt_stats(turns), ses.optimal_length(buckets)).collect()] == ["session_length"]
    assert ses.document_insight(ses.document_effect(calls, "f", turns=turns)).count() == 0


def test_corrections_move_the_optimal_length(spark):
    rows = [(0, "< 30min", 3, 0.002, 1.0, 0.0, 25.0), (2, "1-2h", 3, 0.001, 1.0, 0.0, 0.0), (5, "8h+", 1, 0.9, 1.0, 0.0, 0.0)]
    buckets = spark.createDataFrame(rows, "bucket int, label string, sessions long, avg_token_ratio double, avg_tool_success double, avg_edits_per_file double, avg_corrections double")
    assert ses.optimal_length(buckets).first().optimal_length == "1-2h"  # 0.5 against 2.0; a bucket of one session does not count
    assert ses.optimal_length(buckets.drop("avg_corrections")).first().optimal_length == "< 30min"


def test_every_advice(spark):
    calls = spark.createDataFrame([call("a", n, n, "Edit", "f", i=100_000, o=1) for n in range(25)], CALLS)
    turns = spark.createDataFrame([("a", at(n), "undo that" if n % 2 else "ok") for n in range(10)], "session_id string, ts timestamp, prompt string")
    sessions = ses.efficiency(calls, turns)
    advice = ses.workflow_advice(sessions, ses.file_churn(calls), ses.prompt_stats(turns), ses.optimal_length(ses.length_buckets(sessions)))
    got = {r.advice: (r.subject, r.value) for r in advice.collect()}
    assert got == {
        "low_token_efficiency": (None, 0.00001), "many_edits_per_file": (None, 25.0), "split_file": ("f", 25.0), "many_corrections": (None, 0.5),
        "short_prompts": (None, 5.5), "session_length": ("< 30min", None),
    }


def test_a_document_that_sessions_read(spark):
    read = [call("a", n, n, "Read", "GUIDE.md") for n in range(3)]
    calls = spark.createDataFrame(read + [call("b", n, n) for n in range(3)] + [call("c", n, n) for n in range(2)], CALLS)
    turns = spark.createDataFrame([("a", at(0), "fine"), ("b", at(0), "that is wrong"), ("b", at(1), "fine"), ("c", at(1), "undo")], "session_id string, ts timestamp, prompt string")
    effect = ses.document_effect(calls, "GUIDE.md", turns=turns)
    assert {r.reads_it: (r.sessions, r.correction_rate) for r in effect.collect()} == {True: (1, 0.0), False: (1, 0.5)}  # c has two calls
    assert {r.metric: r.delta_pct for r in ses.document_insight(effect).collect()} == {"correction_rate": -100.0, "token_ratio": 0.0}


def test_health_of_conversations_and_logs(spark):
    talk = ses.session_summary(spark.createDataFrame([call("both", 1, 0), call("both", 2, 60), call("talk", 1, 0)], CALLS))
    lines = [("both", 1, "2024-01-01T00:00:00.000Z [ERROR] Bash tool error (3ms): x"), ("log", 1, "2024-01-01T00:00:00.000Z [ERROR] API error (attempt 1/5): y"), ("log", 2, "2024-01-01T02:00:00.000Z [DEBUG] tick")]
    summary = logs.log_summary(logs.events(spark.createDataFrame(lines, "session_id string, line_no long, line string")))
    got = {r.session_id: r for r in logs.joined_health(talk, summary).collect()}
    assert {k: (r.has_conversation, r.has_log, r.ai_calls, r.hours) for k, r in got.items()} == {"both": (True, True, 2, 1.0), "talk": (True, False, 1, 0.0), "log": (False, True, 0, 2.0)}
    assert (got["talk"].score, got["talk"].grade) == (100, "A")
    assert (got["both"].tool_reliability, got["log"].api_reliability) == (92, 85)
