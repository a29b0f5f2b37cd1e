"""Typed inputs of the operators made of the driver's tables, each with the same rule as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_parents(spans: DataFrame) -> DataFrame:
    """Spans of a trace hang in a heap: the parent of the n-th is the one of number n div 2."""
    parents = spans.select(F.col("trace_id").alias("__trace"), F.col("span_ord").alias("__ord"), F.col("span_id").alias("parent_span_id"))
    return spans.join(parents, (F.col("trace_id") == F.col("__trace")) & (F.expr("span_ord div 2") == F.col("__ord")), "left").drop("__trace", "__ord")


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span for each event; a trace is a user's day."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("trace_id", F.expr("concat('u', user_id, '-', date_format(ts, 'yyyy-MM-dd'))"))
    e = e.withColumn("span_ord", F.row_number().over(Window.partitionBy("trace_id").orderBy("ts", "event_id")).cast("long"))
    return with_parents(
        e.selectExpr(
            "trace_id", "span_ord", "cast(event_id as string) as span_id",
            "case when event_type = 'purchase' then 'tool_call' when event_type = 'signup' then 'agent' when k = 7 then '' else 'chat' end as operation",
            "case when k % 4 <> 1 then concat('prov', k % 3) end as provider",
            "case when k % 2 = 0 then concat('m', k % 4) end as model_requested",
            "case when k % 3 <> 0 then concat('m', k % 4) end as model_used",
            "ts as start_time", "case when k % 10 <> 0 then ts + make_interval(0, 0, 0, 0, 0, 0, 1) end as end_time", "value as duration_ms",
            "case when k % 5 <> 0 then k end as input_tokens", "case when k % 7 <> 0 then cast(floor(value) as bigint) end as output_tokens",
            "case when event_type = 'error' then concat('err', k % 3) end as error_type",
            "case when event_type = 'click' then 'stop' when event_type = 'view' then 'length' end as finish_reason",
            "concat('a', event_id % 3) as agent_id", "concat('agent ', event_id % 3) as agent_name",
            "case when k % 6 = 0 then 'crewai' when k % 6 = 1 then 'langgraph' end as agent_framework",
            "case when k = 13 then 'human_review' end as span_kind", "user_id",
        )
    )


EVENT_SPANS_SQL = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'u' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS trace_id FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts, event_id) AS span_ord FROM ev),
spans AS (SELECT n.trace_id, n.span_ord, CAST(n.event_id AS VARCHAR) AS span_id, CAST(p.event_id AS VARCHAR) AS parent_span_id,
  CASE WHEN n.event_type = 'purchase' THEN 'tool_call' WHEN n.event_type = 'signup' THEN 'agent' WHEN n.k = 7 THEN '' ELSE 'chat' END AS operation,
  CASE WHEN n.k % 4 <> 1 THEN 'prov' || (n.k % 3) END AS provider, CASE WHEN n.k % 2 = 0 THEN 'm' || (n.k % 4) END AS model_requested,
  CASE WHEN n.k % 3 <> 0 THEN 'm' || (n.k % 4) END AS model_used, n.ts AS start_time, CASE WHEN n.k % 10 <> 0 THEN n.ts + INTERVAL 1 SECOND END AS end_time,
  n.value AS duration_ms, CASE WHEN n.k % 5 <> 0 THEN n.k END AS input_tokens, CASE WHEN n.k % 7 <> 0 THEN CAST(floor(n.value) AS BIGINT) END AS output_tokens,
  CASE WHEN n.event_type = 'error' THEN 'err' || (n.k % 3) END AS error_type,
  CASE WHEN n.event_type = 'click' THEN 'stop' WHEN n.event_type = 'view' THEN 'length' END AS finish_reason,
  'a' || (n.event_id % 3) AS agent_id, 'agent ' || (n.event_id % 3) AS agent_name,
  CASE WHEN n.k % 6 = 0 THEN 'crewai' WHEN n.k % 6 = 1 THEN 'langgraph' END AS agent_framework,
  CASE WHEN n.k = 13 THEN 'human_review' END AS span_kind, n.user_id
  FROM numbered n LEFT JOIN numbered p ON n.trace_id = p.trace_id AND n.span_ord // 2 = p.span_ord)"""


def log_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One assistant call of a coding session for each event; a session is a user."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.selectExpr(
        "user_id as session_id", "event_id as ord", "ts", "date_format(ts, 'yyyy-MM-dd') as day",
        "k * 100 + if(k % 2 = 0, k * 60, 0) + if(k % 3 = 0, k * 10, 0) as input_tokens", "if(k % 2 = 0, k * 60, 0) as cache_read", "if(k % 3 = 0, k * 10, 0) as cache_create",
        "cast(floor(value) as bigint) as output_tokens", "concat('m', k % 4) as model", "if(k % 9 = 0, 'none', if(k % 2 = 0, 'tool_use', 'end_turn')) as stop_reason",
        "case event_type when 'click' then 'Read' when 'view' then 'Edit' when 'purchase' then 'Write' when 'error' then 'Bash' else 'Agent' end as tool",
        "case when event_type in ('click', 'view', 'purchase') then concat('f', k % 12) end as file",
        "case when event_type = 'error' then concat('cmd', k % 4, ' --x') end as command",
    )


LOG_CALLS_SQL = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
calls AS (SELECT user_id AS session_id, event_id AS ord, ts, strftime(ts, '%Y-%m-%d') AS day,
  k * 100 + CASE WHEN k % 2 = 0 THEN k * 60 ELSE 0 END + CASE WHEN k % 3 = 0 THEN k * 10 ELSE 0 END AS input_tokens,
  CASE WHEN k % 2 = 0 THEN k * 60 ELSE 0 END AS cache_read, CASE WHEN k % 3 = 0 THEN k * 10 ELSE 0 END AS cache_create,
  CAST(floor(value) AS BIGINT) AS output_tokens, 'm' || (k % 4) AS model, CASE WHEN k % 9 = 0 THEN 'none' WHEN k % 2 = 0 THEN 'tool_use' ELSE 'end_turn' END AS stop_reason,
  CASE event_type WHEN 'click' THEN 'Read' WHEN 'view' THEN 'Edit' WHEN 'purchase' THEN 'Write' WHEN 'error' THEN 'Bash' ELSE 'Agent' END AS tool,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'f' || (k % 12) END AS file,
  CASE WHEN event_type = 'error' THEN 'cmd' || (k % 4) || ' --x' END AS command FROM ev)"""


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of conversations, with questions, commands and corrections woven in by rule."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.selectExpr("conv_id", "turn", "concat(if(turn % 4 = 2, 'actually, let''s do ', ''), if(conv_id % 5 = 1, 'fix ', ''), coalesce(text, ''), if(conv_id % 3 = 0, '?', '')) as prompt")


PROMPTS_SQL = """
prompts AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN 'actually, let''s do ' ELSE '' END || CASE WHEN conv_id % 5 = 1 THEN 'fix ' ELSE '' END || coalesce(text, '') || CASE WHEN conv_id % 3 = 0 THEN '?' ELSE '' END AS prompt
  FROM conversations WHERE role = 'user')"""


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user said half a minute before a call: every second event has such a turn; of these some correct, some only doubt, some are blank or null."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.where("event_type in ('click', 'view') or k % 4 = 0").selectExpr(
        "user_id as session_id", "ts - make_interval(0, 0, 0, 0, 0, 0, 30) as ts", "date_format(ts, 'yyyy-MM-dd') as day",
        "case when k % 10 = 0 then concat('No, not that: take ', event_id) when k % 10 = 1 then 'this is wrong.' when k % 10 = 2 then 'Actually, let''s do the other' "
        "when k % 10 = 3 then '  ' when k % 10 = 4 then cast(null as string) when k % 10 = 5 then 'undo' else concat('add step ', k) end as prompt",
    )


USER_TURNS_SQL = """
turns AS (SELECT user_id AS session_id, ts - INTERVAL 30 SECOND AS ts, CASE WHEN k % 10 = 0 THEN 'No, not that: take ' || event_id WHEN k % 10 = 1 THEN 'this is wrong.' WHEN k % 10 = 2 THEN 'Actually, let''s do the other'
  WHEN k % 10 = 3 THEN '  ' WHEN k % 10 = 4 THEN NULL WHEN k % 10 = 5 THEN 'undo' ELSE 'add step ' || k END AS prompt FROM ev WHERE event_type IN ('click', 'view') OR k % 4 = 0)"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debug-log lines of sessions (users), one for each event."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.selectExpr(
        "user_id as session_id", "event_id as line_no",
        "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\"), ' [', case when event_type = 'error' then 'ERROR' when k % 5 = 0 then 'WARN' when k % 5 = 1 then 'INFO' else 'DEBUG' end, '] ', "
        "case when event_type = 'error' then concat('Bash tool error (', k, 'ms): exit ', k % 3) "
        "when event_type = 'view' and k > 80 then concat('Streaming stall detected: ', k, '.5s gap between events (stall #', k % 4, ')') "
        "when event_type = 'purchase' and k < 5 then concat('API error (attempt ', k, '/5): overloaded') "
        "when event_type = 'signup' and k % 2 = 0 then concat('MCP server \"srv', k % 3, '\": connection failed after ', k, 'ms: refused') "
        "when event_type = 'signup' then concat('MCP server \"srv', k % 3, '\": connected after ', k, 'ms') "
        "when event_type = 'click' and k % 11 = 0 then concat('Applying permission update: Adding ', k, ' allow rule(s) to destination ''dest', k % 2, '''') "
        "when event_type = 'click' and k % 11 = 1 then concat('[STARTUP] setup() completed in ', k * 40, 'ms') "
        "else 'tick' end) as line",
    )


LOG_LINES_SQL = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
lines AS (SELECT user_id AS session_id, event_id AS line_no, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(floor(date_part('microsecond', ts) % 1000000 / 1000) AS BIGINT) AS VARCHAR), 3, '0') || 'Z [' ||
  CASE WHEN event_type = 'error' THEN 'ERROR' WHEN k % 5 = 0 THEN 'WARN' WHEN k % 5 = 1 THEN 'INFO' ELSE 'DEBUG' END || '] ' ||
  CASE WHEN event_type = 'error' THEN 'Bash tool error (' || k || 'ms): exit ' || (k % 3)
    WHEN event_type = 'view' AND k > 80 THEN 'Streaming stall detected: ' || k || '.5s gap between events (stall #' || (k % 4) || ')'
    WHEN event_type = 'purchase' AND k < 5 THEN 'API error (attempt ' || k || '/5): overloaded'
    WHEN event_type = 'signup' AND k % 2 = 0 THEN 'MCP server "srv' || (k % 3) || '": connection failed after ' || k || 'ms: refused'
    WHEN event_type = 'signup' THEN 'MCP server "srv' || (k % 3) || '": connected after ' || k || 'ms'
    WHEN event_type = 'click' AND k % 11 = 0 THEN 'Applying permission update: Adding ' || k || ' allow rule(s) to destination ''dest' || (k % 2) || ''''
    WHEN event_type = 'click' AND k % 11 = 1 THEN '[STARTUP] setup() completed in ' || (k * 40) || 'ms' ELSE 'tick' END AS line FROM ev)"""
