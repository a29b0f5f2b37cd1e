"""The registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import codescan as code
from .operators import coverage as cov
from .operators import delegation as dag
from .operators import flows, logs, scan
from .operators import penalties as pen
from .operators import sessions as ses
from .operators import syntax
from .plans import rules
from .sources import adapters as src
from .sources import files, packs, traces, written
from .staging import own_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- requirements over spans -------------------------------------------------------------------------------------------


def _measured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(spans, applicable rules with scores, evidence fields, coverage)."""
    spans = src.event_spans(spark, sf_dir)
    fields = rules.evidence_fields(spark)
    covered = cov.coverage(spans, [(f, c) for _, _, f, _, c in rules.parsed()[1]])
    return spans, cov.scored(rules.applicable(rules.requirements(spark)), fields, covered), fields, covered


_FIELDS = {f for _, _, f, _, _ in rules.parsed()[1]}
_SPAN_SQL = {f: f for f in ("operation", "provider", "model_used", "model_requested", "input_tokens", "output_tokens", "duration_ms", "error_type", "span_id", "parent_span_id", "start_time", "end_time")} | {"finish_reasons": "finish_reason"}


def _count_sql(field: str, check: str) -> str:
    column = _SPAN_SQL.get(field)
    if check == "present":
        return "count(*)"
    if column is None:
        return "CAST(0 AS BIGINT)"
    return f"count(*) FILTER (WHERE {column} IS NOT NULL" + (f" AND length({column}) > 0)" if check == "non_empty" else ")")


_PAIRS = sorted({(f, c) for _, _, f, _, c in rules.parsed()[1]})
_COVERED = ",\ncovered AS (" + "\nUNION ALL ".join(f"SELECT '{f}' AS field, '{c}' AS check_type, count(*) AS population, {_count_sql(f, c)} AS present_count FROM spans" for f, c in _PAIRS) + ")"
_SCORED = """,
cover AS (SELECT *, CASE WHEN population > 0 THEN present_count / population ELSE 0.0 END AS coverage FROM covered),
sums AS (SELECT f.rule_id, sum(coverage * weight) / sum(weight) AS score FROM fields f JOIN cover c ON f.field = c.field AND f.check_type = c.check_type GROUP BY f.rule_id),
scored AS (SELECT r.*, coalesce(s.score, 1.0) AS score FROM rules r LEFT JOIN sums s ON r.rule_id = s.rule_id WHERE list_contains(applies_to, 'high_risk') OR list_contains(applies_to, 'all')),
audited AS (SELECT *, CASE WHEN score >= 0.95 THEN 'satisfied' WHEN score >= 0.25 THEN 'partial' ELSE 'missing' END AS status FROM scored),
gaps AS (SELECT a.rule_id, a.regulation, a.score, f.field_ord, 'spans[].' || f.field AS field_path, CASE WHEN c.present_count = 0 THEN 'Not logging: ' ELSE 'Incomplete: ' END || replace(f.field, '_', ' ') AS description,
  round_even(c.coverage * 100, 1) AS coverage_pct, c.present_count, c.population FROM audited a JOIN fields f ON a.rule_id = f.rule_id JOIN cover c ON f.field = c.field AND f.check_type = c.check_type WHERE c.coverage < 0.95)
"""
_AUDIT = f"WITH {rules.sql_values()},{src.EVENT_SPANS_SQL}{_COVERED}{_SCORED}"


@query(f"{_AUDIT} SELECT field, check_type, population, present_count, round(coverage, 9) AS coverage FROM cover")
def field_coverage(spark, sf_dir):
    return _measured(spark, sf_dir)[3].withColumn("coverage", F.round("coverage", 9))


@query(f"{_AUDIT} SELECT rule_id, regulation, severity, round(score, 6) AS score, status FROM audited")
def requirement_audit(spark, sf_dir):
    return _measured(spark, sf_dir)[1].select("rule_id", "regulation", "severity", F.round("score", 6).alias("score"), "status")


@query(f"{_AUDIT} SELECT rule_id, regulation, field_path, description, coverage_pct, present_count, population FROM gaps")
def gap_list(spark, sf_dir):
    _, scored, fields, covered = _measured(spark, sf_dir)
    return cov.gaps(scored, fields, covered).drop("field_ord")


_ADVICE_SQL = "CASE split_part(field_path, '.', -1) " + " ".join(f"WHEN '{f}' THEN '{t.replace(chr(39), chr(39) * 2)}'" for f, t in cov.ADVICE.items()) + " ELSE 'Add `' || field_path || '` to your trace exports. Currently ' || present_count || '/' || population || ' spans include this field.' END"


@query(
    f"""{_AUDIT} SELECT rule_id, field_path, regulation || ' ' || rule_id || ' — ' || CASE WHEN present_count = 0 THEN 'your traces contain zero values for `' || field_path || '`.' ELSE 'only ' || present_count || '/' || population || ' spans have `' || field_path || '`.' END AS impact,
  {_ADVICE_SQL} AS recommendation FROM gaps"""
)
def gap_advice(spark, sf_dir):
    _, scored, fields, covered = _measured(spark, sf_dir)
    return cov.gap_advice(cov.gaps(scored, fields, covered))


@query(
    f"""{_AUDIT}, per AS (SELECT rule_id, count(*) AS n, string_agg(field_path, ',' ORDER BY field_ord) AS paths FROM gaps GROUP BY rule_id)
SELECT regulation, round(avg(score), 6) AS overall_score, count(*) FILTER (WHERE status = 'satisfied') AS n_satisfied, count(*) FILTER (WHERE status = 'partial') AS n_partial, count(*) FILTER (WHERE status = 'missing') AS n_missing,
  string_agg(a.rule_id || ' ' || status || ' ' || coalesce(paths, ''), '; ' ORDER BY a.rule_id) AS requirements FROM audited a LEFT JOIN per p ON a.rule_id = p.rule_id GROUP BY regulation"""
)
def gap_report(spark, sf_dir):
    """The nested report, written as JSON and read back."""
    _, scored, fields, covered = _measured(spark, sf_dir)
    path, told = own_path(spark, "report"), cov.report(scored, cov.gaps(scored, fields, covered))
    told.write.json(path)
    back = spark.read.schema(told.schema).json(path)
    line = F.transform("requirements", lambda r: F.concat_ws(" ", r["rule_id"], r["status"], F.array_join(F.transform(r["gaps"], lambda g: g["field_path"]), ",")))
    return back.select("regulation", F.round("overall_score", 6).alias("overall_score"), "n_satisfied", "n_partial", "n_missing", F.array_join(line, "; ").alias("requirements"))


@query(f"{_AUDIT} SELECT rule_id, field_path, description, round(score, 6) AS score FROM gaps ORDER BY gaps.score, description DESC, rule_id, field_ord LIMIT 5")
def top_gaps(spark, sf_dir):
    _, scored, fields, covered = _measured(spark, sf_dir)
    return cov.top_gaps(scored, cov.gaps(scored, fields, covered)).withColumn("score", F.round("score", 6))


@query(f"{_AUDIT} SELECT tier, round(avg(score), 6) AS tier_score, count(*) AS n_rules, count(*) FILTER (WHERE status = 'satisfied') AS n_satisfied, count(*) FILTER (WHERE status <> 'satisfied') AS n_gaps FROM audited WHERE tier IS NOT NULL GROUP BY tier")
def tiered_scores(spark, sf_dir):
    return cov.tiers(_measured(spark, sf_dir)[1]).withColumn("tier_score", F.round("tier_score", 6))


@query(f"{_AUDIT} SELECT count(*) AS n_rules, count(*) FILTER (WHERE status = 'satisfied') AS n_satisfied, count(*) FILTER (WHERE status = 'partial') AS n_partial, count(*) FILTER (WHERE status = 'missing') AS n_missing, round(avg(score), 6) AS overall_score FROM audited")
def audit_summary(spark, sf_dir):
    return cov.summary(_measured(spark, sf_dir)[1]).withColumn("overall_score", F.round("overall_score", 6))


@query(f"WITH {rules.sql_values()} SELECT rule_id, regulation, severity FROM rules WHERE (list_contains(applies_to, 'financial_institution') OR list_contains(applies_to, 'all')) AND regulation IN ('EU AI Act', 'ISO 42001')")
def applicable_rules(spark, sf_dir):
    return rules.applicable(rules.requirements(spark), "financial_institution", ["EU AI Act", "ISO 42001"]).select("rule_id", "regulation", "severity")


@query(f"WITH {rules.sql_values()} SELECT r.regulation, r.severity, count(DISTINCT r.rule_id) AS n_rules, count(f.field) AS n_fields FROM rules r LEFT JOIN fields f ON r.rule_id = f.rule_id GROUP BY r.regulation, r.severity")
def rule_catalogue(spark, sf_dir):
    r = rules.requirements(spark).join(rules.evidence_fields(spark), "rule_id", "left")
    return r.groupBy("regulation", "severity").agg(F.countDistinct("rule_id").alias("n_rules"), F.count("field").alias("n_fields"))


@query(f"WITH {src.EVENT_SPANS_SQL}, firsts AS (SELECT model_used AS sample, min((trace_id, span_ord)) AS first_at FROM spans WHERE model_used IS NOT NULL GROUP BY model_used) SELECT row_number() OVER (ORDER BY first_at) AS sample_ord, sample FROM firsts ORDER BY first_at LIMIT 5")
def coverage_samples(spark, sf_dir):
    return cov.samples(src.event_spans(spark, sf_dir), "model_used")


_SAMPLED = ["agent_framework", "error_type", "model_used", "provider", "span_id", "span_kind", "temperature"]


@query(
    f"WITH {src.EVENT_SPANS_SQL}, seen AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS field, CAST({'NULL' if f == 'temperature' else f} AS VARCHAR) AS sample, trace_id, span_ord FROM spans" for f in _SAMPLED)
    + "), firsts AS (SELECT field, sample, min((trace_id, span_ord)) AS first_at FROM seen WHERE sample IS NOT NULL GROUP BY field, sample), best AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY first_at) AS n FROM firsts QUALIFY n <= 5), "
    "each AS (SELECT DISTINCT field FROM seen) SELECT e.field, coalesce(string_agg(sample, '|' ORDER BY n), '') AS samples FROM each e LEFT JOIN best b ON e.field = b.field GROUP BY e.field"
)
def field_samples(spark, sf_dir):
    """Ids of spans are all distinct, so each task holds only its five."""
    return cov.coverage_samples(src.event_spans(spark, sf_dir), _SAMPLED).withColumn("samples", F.array_join("samples", "|"))


@query(
    f"WITH {src.EVENT_SPANS_SQL} SELECT trace_id, count(*) AS n_spans, count(DISTINCT nullif(agent_id, '')) AS n_agents, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens, "
    "string_agg(DISTINCT coalesce(model_used, model_requested, 'unknown'), ',' ORDER BY coalesce(model_used, model_requested, 'unknown')) AS models, min(start_time) AS first_time, max(start_time) AS last_time, count(DISTINCT nullif(agent_id, '')) > 1 AS is_multi_agent FROM spans GROUP BY trace_id"
)
def trace_summary(spark, sf_dir):
    return cov.trace_totals(src.event_spans(spark, sf_dir))


# --- delegation ----------------------------------------------------------------------------------------------------------

_SPANS = f"WITH RECURSIVE {src.EVENT_SPANS_SQL}"
_WALK = """,
walk AS (SELECT trace_id, span_id, 0 AS depth, [agent_id] AS chain FROM spans WHERE parent_span_id IS NULL
  UNION ALL SELECT s.trace_id, s.span_id, w.depth + 1, list_append(list_filter(w.chain, lambda x: x <> s.agent_id), s.agent_id) FROM walk w JOIN spans s ON s.trace_id = w.trace_id AND s.parent_span_id = w.span_id)"""
_AGENTS = """,
agents AS (SELECT s.trace_id, s.agent_id AS agent, count(*) AS n_spans, min_by(s.agent_name, s.span_ord) AS agent_name,
  bool_or(lower(s.operation) IN ('human_review', 'human_approval', 'human_oversight', 'approval') OR coalesce(s.span_kind, '') IN ('human_review', 'human_approval', 'human_oversight', 'approval')) AS has_oversight, max(w.depth) AS max_depth
  FROM spans s JOIN walk w ON s.trace_id = w.trace_id AND s.span_id = w.span_id GROUP BY s.trace_id, s.agent_id)"""


@query(f"{_SPANS} SELECT trace_id, parent_span_id AS parent_id, span_id AS child_id, span_ord AS child_ord FROM spans WHERE parent_span_id IS NOT NULL")
def span_edges(spark, sf_dir):
    return dag.edges(src.event_spans(spark, sf_dir))


@query(f"{_SPANS} SELECT trace_id, span_id FROM spans WHERE parent_span_id IS NULL")
def root_spans(spark, sf_dir):
    return dag.roots(src.event_spans(spark, sf_dir))


@query(f"{_SPANS}{_WALK} SELECT trace_id, span_id, depth FROM walk")
def delegation_depth(spark, sf_dir):
    return dag.depths(src.event_spans(spark, sf_dir))


@query(f"{_SPANS}{_WALK} SELECT trace_id, span_id, array_to_string(chain, '>') AS delegation_path FROM walk")
def delegation_paths(spark, sf_dir):
    return dag.paths(src.event_spans(spark, sf_dir)).withColumn("delegation_path", F.array_join("delegation_path", ">"))


@query(
    f"""{_SPANS}, multi AS (SELECT trace_id FROM spans GROUP BY trace_id HAVING count(DISTINCT agent_id) > 1) SELECT p.trace_id, p.span_id AS parent_id, (s.span_ord - 1) // 2 AS part, string_agg(s.span_id, ',' ORDER BY s.span_ord) AS children
FROM spans s JOIN spans p ON s.trace_id = p.trace_id AND s.parent_span_id = p.span_id WHERE s.trace_id IN (SELECT trace_id FROM multi) GROUP BY ALL"""
)
def span_adjacency(spark, sf_dir):
    """Children of spans in traces of several agents, in lists of two places."""
    spans = src.event_spans(spark, sf_dir)
    return dag.adjacency(spans.join(dag.several_agents(spans), "trace_id", "left_semi"), part=2).withColumn("children", F.array_join("children", ","))


@query(f"{_SPANS}{_WALK}, multi AS (SELECT trace_id FROM spans GROUP BY trace_id HAVING count(DISTINCT agent_id) > 1) SELECT w.trace_id, span_id, CASE WHEN m.trace_id IS NOT NULL THEN array_to_string(chain, '>') END AS delegation_path FROM walk w LEFT JOIN multi m ON w.trace_id = m.trace_id")
def enriched_spans(spark, sf_dir):
    """Spans of all traces; those of traces of one agent have no path."""
    return dag.enriched(src.event_spans(spark, sf_dir)).select("trace_id", "span_id", F.array_join("delegation_path", ">").alias("delegation_path"))


@query(f"{_SPANS}{_WALK}{_AGENTS} SELECT * FROM agents")
def agent_summary(spark, sf_dir):
    return dag.agent_summary(src.event_spans(spark, sf_dir))


@query(f"{_SPANS}{_WALK}{_AGENTS} SELECT trace_id, agent FROM agents WHERE NOT has_oversight")
def unsupervised_agents(spark, sf_dir):
    return dag.unsupervised(dag.agent_summary(src.event_spans(spark, sf_dir)))


@query(f"{_SPANS} SELECT DISTINCT s.trace_id, p.agent_id AS from_agent, s.agent_id AS to_agent FROM spans s JOIN spans p ON s.trace_id = p.trace_id AND s.parent_span_id = p.span_id WHERE p.agent_id <> s.agent_id")
def agent_edges(spark, sf_dir):
    return dag.agent_edges(src.event_spans(spark, sf_dir))


def _twisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of which every tenth trace's root hangs on the trace's last span: cycles to find."""
    spans = src.event_spans(spark, sf_dir)
    last = spans.groupBy("trace_id").agg(F.max_by("span_id", "span_ord").alias("last"))
    turn = (F.col("span_ord") == 1) & (F.col("user_id") % 10 == 0)
    return spans.join(last, "trace_id").withColumn("parent_span_id", F.when(turn, F.col("last")).otherwise(F.col("parent_span_id")))


@query(
    f"""{_SPANS}, lasts AS (SELECT trace_id, max_by(span_id, span_ord) AS last FROM spans GROUP BY trace_id),
e AS (SELECT s.trace_id, s.span_id AS a, CASE WHEN s.span_ord = 1 AND s.user_id % 10 = 0 THEN l.last ELSE s.parent_span_id END AS b FROM spans s JOIN lasts l ON s.trace_id = l.trace_id),
walk AS (SELECT trace_id, a AS first_a, b AS now_at, [a] AS way FROM e WHERE b IS NOT NULL
  UNION ALL SELECT w.trace_id, w.first_a, e.b, list_append(w.way, w.now_at) FROM walk w JOIN e ON w.trace_id = e.trace_id AND w.now_at = e.a WHERE w.now_at <> w.first_a AND e.b IS NOT NULL AND NOT list_contains(w.way, w.now_at))
SELECT DISTINCT trace_id, array_to_string(way, '>') AS cycle FROM walk WHERE now_at = first_a AND first_a = list_min(way)"""
)
def cycle_check(spark, sf_dir):
    return dag.cycles(_twisted(spark, sf_dir)).withColumn("cycle", F.array_join("cycle", ">"))


def _agent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own scores are an agent's share of spans without error in its trace; penalties go up all delegations."""
    spans = src.event_spans(spark, sf_dir)
    own = spans.groupBy("trace_id", F.col("agent_id").alias("agent")).agg((F.count_if(F.col("error_type").isNull()) / F.count(F.lit(1))).alias("own_score"), F.count(F.lit(1)).alias("n_spans"))
    solved = pen.penalties(own, dag.agent_edges(spans))
    return solved.join(own.select("trace_id", "agent", "n_spans"), ["trace_id", "agent"])


def _round_sql(before: str, graph: str) -> str:
    """One round: agents are solved whose delegates all are."""
    return f"""SELECT v.trace_id, v.agent, v.own_score, v.n_spans, coalesce(v.penalty, CASE WHEN g.f IS NULL THEN 0.0 WHEN g.missing = 0 THEN g.lost END)::DOUBLE AS penalty FROM {before} v LEFT JOIN
  (SELECT trace_id, f, count(*) FILTER (WHERE final IS NULL) AS missing, sum(CASE WHEN final < 0.95 THEN 0.5 * (1 - final) ELSE 0.0 END) AS lost FROM (SELECT e.trace_id, e.f, CASE WHEN e.broken THEN greatest(0.0, t.own_score) WHEN t.penalty IS NOT NULL THEN greatest(0.0, t.own_score - t.penalty) END AS final
    FROM {graph} e JOIN {before} t ON e.trace_id = t.trace_id AND e.t = t.agent) GROUP BY trace_id, f) g ON v.trace_id = g.trace_id AND v.agent = g.f"""


# The tables have three agents a trace: three rounds solve what hangs on no cycle, three take away what leads to one, and three solve the rest.
_PENALTY = (
    """,
own AS (SELECT trace_id, agent_id AS agent, count(*) FILTER (WHERE error_type IS NULL) / count(*) AS own_score, count(*) AS n_spans FROM spans GROUP BY trace_id, agent_id),
g0 AS (SELECT DISTINCT s.trace_id, p.agent_id AS f, s.agent_id AS t, false AS broken FROM spans s JOIN spans p ON s.trace_id = p.trace_id AND s.parent_span_id = p.span_id WHERE p.agent_id <> s.agent_id),
v0 AS (SELECT *, NULL::DOUBLE AS penalty FROM own)"""
    + "".join(f",\nv{i} AS ({_round_sql(f'v{i - 1}', 'g0')})" for i in (1, 2, 3))
    + ",\nk0 AS (SELECT trace_id, agent FROM v3 WHERE penalty IS NULL)"
    + "".join(f",\nk{i} AS (SELECT DISTINCT e.trace_id, e.t AS agent FROM g0 e JOIN k{i - 1} a ON e.trace_id = a.trace_id AND e.f = a.agent JOIN k{i - 1} b ON e.trace_id = b.trace_id AND e.t = b.agent)" for i in (1, 2, 3))
    + ",\ng1 AS (SELECT e.trace_id, e.f, e.t, a.agent IS NOT NULL AND b.agent IS NOT NULL AND e.t < e.f AS broken FROM g0 e LEFT JOIN k3 a ON e.trace_id = a.trace_id AND e.f = a.agent LEFT JOIN k3 b ON e.trace_id = b.trace_id AND e.t = b.agent)"
    + "".join(f",\nv{i} AS ({_round_sql(f'v{i - 1}', 'g1')})" for i in (4, 5, 6))
    + ",\nsolved AS (SELECT *, least(1.0, greatest(0.0, own_score - penalty)) AS final_score FROM v6)"
)


@query(f"{_SPANS}{_PENALTY} SELECT trace_id, agent, n_spans, round(own_score, 6) AS own_score, round(penalty, 6) AS penalty, round(final_score, 6) AS final_score FROM solved")
def agent_scores(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    return _agent_scores(spark, sf_dir).select("trace_id", "agent", "n_spans", r("own_score"), r("penalty"), r("final_score"))


@query(f"{_SPANS}{_PENALTY} SELECT trace_id, round_even(sum(final_score * n_spans) / sum(n_spans), 4) AS system_score FROM solved GROUP BY trace_id")
def system_score(spark, sf_dir):
    return dag.system_score(_agent_scores(spark, sf_dir))


@query(
    f"{_SPANS}, per AS (SELECT trace_id, string_agg(DISTINCT model_used, ', ' ORDER BY model_used) AS models, string_agg(DISTINCT agent_framework, ', ' ORDER BY agent_framework) AS frameworks, count(DISTINCT model_used) AS nm, count(DISTINCT agent_framework) AS nf FROM spans GROUP BY trace_id) "
    "SELECT trace_id, coalesce(models, '') AS models, coalesce(frameworks, '') AS frameworks, nm > 1 AS several_models, nf > 1 AS several_frameworks FROM per WHERE nm > 1 OR nf > 1"
)
def liability_shift(spark, sf_dir):
    return dag.liability_shifts(src.event_spans(spark, sf_dir))


# --- sessions ------------------------------------------------------------------------------------------------------------

_CALLS = f"WITH {src.LOG_CALLS_SQL}"
_SUMS = "CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_create) AS BIGINT) AS cache_create"
_COST = "({fresh}) / 1e6 * 15.0 + cache_create / 1e6 * 18.75 + cache_read / 1e6 * 1.5 + output_tokens / 1e6 * 75.0"
_WITH_CACHE = _COST.format(fresh="input_tokens - cache_read - cache_create")
_WITH_CACHE_FLOOR = _COST.format(fresh="greatest(0, input_tokens - cache_read - cache_create)")


@query(
    f"""{_CALLS}, tools AS (SELECT session_id, tool, count(*) AS n, min(ord) AS f FROM calls GROUP BY session_id, tool),
tops AS (SELECT session_id, arg_min(tool, (-n, f)) AS top_tool, CAST(sum(n) AS BIGINT) AS tool_calls FROM tools GROUP BY session_id)
SELECT c.session_id, strftime(min(ts), '%Y-%m-%d') AS day, count(*) AS ai_calls, {_SUMS}, any_value(t.tool_calls) AS tool_calls, any_value(t.top_tool) AS top_tool,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) AS duration_hours, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM calls c JOIN tops t ON c.session_id = t.session_id GROUP BY c.session_id"""
)
def session_summary(spark, sf_dir):
    return ses.session_summary(src.log_calls(spark, sf_dir))


@query(f"{_CALLS}, t AS (SELECT {_SUMS} FROM calls) SELECT *, input_tokens - cache_read - cache_create AS fresh_input, round(cache_read / input_tokens * 100, 6) AS cache_read_pct, round(input_tokens / 1e6 * 15.0 + output_tokens / 1e6 * 75.0, 6) AS cost_no_cache, round({_WITH_CACHE}, 6) AS cost_with_cache FROM t")
def cost_breakdown(spark, sf_dir):
    return ses.cost_breakdown(src.log_calls(spark, sf_dir))


def _counter_sql(column: str, most: int) -> str:
    return f"{_CALLS}, c AS (SELECT {column} AS value, count(*) AS n, min(ord) AS f FROM calls WHERE {column} IS NOT NULL GROUP BY {column}) SELECT value, n, round(n / sum(n) OVER () * 100, 6) AS pct FROM c ORDER BY n DESC, f LIMIT {most}"


@query(_counter_sql("tool", 20))
def tool_usage(spark, sf_dir):
    return ses.counter(src.log_calls(spark, sf_dir), "tool", 20)


@query(_counter_sql("stop_reason", 15))
def top_counters(spark, sf_dir):
    return ses.counter(src.log_calls(spark, sf_dir), "stop_reason", 15)


@query(_counter_sql("split_part(trim(command), ' ', 1)", 15))
def bash_commands(spark, sf_dir):
    calls = src.log_calls(spark, sf_dir).withColumn("word", F.element_at(F.split(F.trim("command"), r"\s+"), 1))
    return ses.counter(calls, "word", 15)


@query(f"{_CALLS} SELECT file, count(*) FILTER (WHERE tool = 'Read') AS reads, count(*) FILTER (WHERE tool = 'Edit') AS edits, count(*) FILTER (WHERE tool = 'Write') AS writes, count(*) AS total FROM calls WHERE file IS NOT NULL GROUP BY file ORDER BY total DESC, file LIMIT 15")
def file_hotspots(spark, sf_dir):
    return ses.file_hotspots(src.log_calls(spark, sf_dir))


@query(f"{_CALLS}, h AS (SELECT hour(ts + INTERVAL 330 MINUTE) AS hour, count(*) AS n FROM calls GROUP BY 1) SELECT CAST(r.range AS INTEGER) AS hour, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER () * 100, 6) AS pct FROM range(24) r LEFT JOIN h ON r.range = h.hour")
def hourly_activity(spark, sf_dir):
    return ses.hourly(src.log_calls(spark, sf_dir), 5.5)


_DAYS = f"{_CALLS}, d AS (SELECT day, count(*) AS calls, {_SUMS} FROM calls GROUP BY day), days AS (SELECT *, {_WITH_CACHE_FLOOR} AS est_cost FROM d)"


@query(f"{_DAYS} SELECT day, calls, input_tokens, output_tokens, cache_read, cache_create, round(est_cost, 6) AS est_cost FROM days")
def daily_cost(spark, sf_dir):
    return ses.daily_cost(src.log_calls(spark, sf_dir)).withColumn("est_cost", F.round("est_cost", 6))


@query(
    f"""{_DAYS}, nd AS (SELECT *, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS n FROM days),
o AS (SELECT max(n) AS active_days, greatest(1, date_diff('day', CAST(min(day) AS DATE), CAST(max(day) AS DATE)) + 1) AS total_days, sum(est_cost) AS total,
  coalesce(sum(est_cost) FILTER (WHERE i <= n // 2), 0) AS h1, coalesce(sum(est_cost) FILTER (WHERE i > n // 2 AND n // 2 > 0), 0) AS h2, avg(est_cost) FILTER (WHERE i > n - 7) AS recent,
  arg_max(day, (est_cost, -i)) AS busiest_day, arg_min(day, (est_cost, i)) AS quietest_day FROM nd),
t AS (SELECT *, CASE WHEN h1 > 0 THEN (h2 - h1) / h1 * 100 ELSE 0 END AS trend_raw FROM o)
SELECT total_days, active_days, round(total / total_days, 6) AS avg_daily_cost, round(total / active_days, 6) AS avg_active_day_cost, CASE WHEN trend_raw > 20 THEN 'increasing' WHEN trend_raw < -20 THEN 'decreasing' ELSE 'stable' END AS trend,
  round(trend_raw, 4) AS trend_pct, round(recent * 7 * (active_days / total_days), 6) AS forecast_7d, round(recent * 30 * (active_days / total_days), 6) AS forecast_30d, busiest_day, quietest_day FROM t"""
)
def cost_forecast(spark, sf_dir):
    return ses.forecast(ses.daily_cost(src.log_calls(spark, sf_dir)))


_PRESSURE = f"""{_CALLS}, nc AS (SELECT session_id, input_tokens AS inp, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS i, count(*) OVER (PARTITION BY session_id) AS n FROM calls),
s AS (SELECT session_id, max(n) AS n, max(inp) AS max_input, CAST(sum(inp) AS BIGINT) AS cumulative_input, CASE WHEN max(inp) > 0 THEN arg_min(i, (-inp, i)) ELSE 0 END AS peak_call,
  coalesce(sum(inp) FILTER (WHERE i <= 5), 0) AS f5, coalesce(sum(inp) FILTER (WHERE i > n - 5), 0) AS l5, coalesce(sum(inp) FILTER (WHERE i > n // 3 AND i <= 2 * n // 3), 0) AS mid,
  coalesce(sum(inp) FILTER (WHERE i > n - CAST(ceil(n / 5) AS BIGINT)), 0) AS late FROM nc WHERE n >= 5 GROUP BY session_id),
pressure AS (SELECT session_id, n AS total_calls, max_input, cumulative_input, peak_call, round(CASE WHEN n >= 10 AND f5 > 0 THEN (l5 / 5 - f5 / 5) / (f5 / 5) ELSE 0.0 END, 6) AS input_growth,
  n >= 20 AND mid / greatest(1, n // 3) > 0 AND late / greatest(1, n // 5) < mid / greatest(1, n // 3) * CAST(0.7 AS DOUBLE) AS likely_compressed FROM s)"""


@query(f"{_PRESSURE} SELECT * FROM pressure")
def context_pressure(spark, sf_dir):
    return ses.context_pressure(src.log_calls(spark, sf_dir))


@query(f"{_PRESSURE} SELECT count(*) AS sessions, count(*) FILTER (WHERE likely_compressed) AS compressed, round(count(*) FILTER (WHERE likely_compressed) / count(*), 6) AS rate, round(avg(cumulative_input), 6) AS avg_cumulative, max(cumulative_input) AS max_cumulative FROM pressure")
def pressure_rollup(spark, sf_dir):
    return ses.pressure_rollup(ses.context_pressure(src.log_calls(spark, sf_dir)))


_CORRECTS = f"regexp_matches(prompt, '{ses.CORRECTION.replace(chr(39), chr(39) * 2)}')"
_EFFICIENCY = f"""{_CALLS},{src.USER_TURNS_SQL}, e AS (SELECT session_id, file, count(*) AS n FROM calls WHERE tool = 'Edit' AND file IS NOT NULL GROUP BY session_id, file),
p AS (SELECT session_id, count(*) AS files_edited, avg(n) AS avg_edits, count(*) FILTER (WHERE n >= 5) AS churn_files FROM e GROUP BY session_id),
said AS (SELECT session_id, count(*) FILTER (WHERE trim(prompt) <> '') AS turns, count(*) FILTER (WHERE {_CORRECTS}) AS corrections, min(ts) AS a, max(ts) AS b FROM turns GROUP BY session_id),
eff AS (SELECT c.session_id, round(CASE WHEN sum(input_tokens) > 0 THEN sum(output_tokens) / sum(input_tokens) ELSE 0.0 END, 9) AS token_ratio, 1.0::DOUBLE AS tool_success, coalesce(any_value(files_edited), 0) AS files_edited,
  round(coalesce(any_value(avg_edits), 0.0), 6) AS avg_edits_per_file, coalesce(any_value(churn_files), 0) AS churn_files, round((epoch_us(greatest(max(ts), any_value(b))) - epoch_us(least(min(ts), any_value(a)))) / 3.6e9, 6) AS duration_hours,
  coalesce(any_value(corrections), 0) AS corrections, round(CASE WHEN any_value(turns) > 0 THEN any_value(corrections) / any_value(turns) ELSE 0.0 END, 6) AS correction_rate
  FROM calls c LEFT JOIN p ON c.session_id = p.session_id LEFT JOIN said s ON c.session_id = s.session_id GROUP BY c.session_id)"""
_BUCKETS = """, lab AS (SELECT *, CASE WHEN duration_hours < 0.5 THEN 0 WHEN duration_hours < 1 THEN 1 WHEN duration_hours < 2 THEN 2 WHEN duration_hours < 4 THEN 3 WHEN duration_hours < 8 THEN 4 WHEN duration_hours < 999 THEN 5 END AS bucket FROM eff),
buckets AS (SELECT bucket, ['< 30min', '30min-1h', '1-2h', '2-4h', '4-8h', '8h+'][bucket + 1] AS label, count(*) AS sessions, round(avg(token_ratio), 9) AS avg_token_ratio, round(avg(tool_success), 6) AS avg_tool_success, round(avg(avg_edits_per_file), 6) AS avg_edits_per_file,
  round(avg(corrections), 6) AS avg_corrections FROM lab WHERE bucket IS NOT NULL GROUP BY bucket),
worth AS (SELECT *, avg_token_ratio * 1000 + avg_tool_success - avg_corrections * 0.1 AS value FROM buckets),
best AS (SELECT coalesce((SELECT label FROM worth WHERE sessions >= 2 AND value > 0 ORDER BY value DESC, bucket LIMIT 1), (SELECT label FROM buckets ORDER BY bucket LIMIT 1), 'Not enough data') AS optimal_length)"""


@query(f"{_EFFICIENCY} SELECT * FROM eff")
def conversation_efficiency(spark, sf_dir):
    return ses.efficiency(src.log_calls(spark, sf_dir), src.user_turns(spark, sf_dir))


def _by_day(calls: DataFrame) -> DataFrame:
    """Sessions of a user's day, which are of all lengths."""
    return calls.withColumn("session_id", F.concat(F.col("session_id").cast("string"), F.lit("-"), "day"))


def _day_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ses.efficiency(_by_day(src.log_calls(spark, sf_dir)), _by_day(src.user_turns(spark, sf_dir)))


_DAY_EFFICIENCY = _EFFICIENCY.replace("SELECT user_id AS session_id,", "SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id,")


@query(f"{_DAY_EFFICIENCY}{_BUCKETS} SELECT label, sessions, avg_token_ratio, avg_tool_success, avg_edits_per_file, avg_corrections FROM buckets")
def length_buckets(spark, sf_dir):
    return ses.length_buckets(_day_efficiency(spark, sf_dir)).drop("bucket")


@query(f"{_DAY_EFFICIENCY}{_BUCKETS} SELECT optimal_length FROM best")
def optimal_length(spark, sf_dir):
    return ses.optimal_length(ses.length_buckets(_day_efficiency(spark, sf_dir)))


@query(
    f"""{_DAY_EFFICIENCY}{_BUCKETS}, means AS (SELECT avg(token_ratio) AS ratio, avg(avg_edits_per_file) AS edits FROM eff), churn AS (SELECT file, count(*) AS n FROM calls WHERE tool = 'Edit' AND file IS NOT NULL GROUP BY file HAVING count(*) >= 5 ORDER BY n DESC, file LIMIT 1),
words AS (SELECT avg(length(prompt)) AS length, count(*) FILTER (WHERE {_CORRECTS}) / count(*) AS corrected FROM turns WHERE trim(prompt) <> '')
SELECT 'low_token_efficiency' AS advice, NULL AS subject, round(ratio, 6) AS value FROM means WHERE ratio < 0.002 UNION ALL SELECT 'many_edits_per_file', NULL, round(edits, 6) FROM means WHERE edits > 4 UNION ALL SELECT 'split_file', file, n FROM churn WHERE n > 20
UNION ALL SELECT 'many_corrections', NULL, round(corrected, 6) FROM words WHERE round(corrected, 6) > 0.1 UNION ALL SELECT 'short_prompts', NULL, round(length, 6) FROM words WHERE length < 30 UNION ALL SELECT 'session_length', optimal_length, NULL FROM best"""
)
def workflow_advice(spark, sf_dir):
    calls, sessions = src.log_calls(spark, sf_dir), _day_efficiency(spark, sf_dir)
    said = ses.prompt_stats(src.user_turns(spark, sf_dir).where(F.trim("prompt") != ""))
    return ses.workflow_advice(sessions, ses.file_churn(calls), said, ses.optimal_length(ses.length_buckets(sessions)))


@query(f"{_CALLS}, p AS (SELECT file, session_id, count(*) FILTER (WHERE tool = 'Edit') AS e, count(*) FILTER (WHERE tool = 'Read') AS r FROM calls WHERE tool IN ('Edit', 'Read') GROUP BY file, session_id), f AS (SELECT file, CAST(sum(e) AS BIGINT) AS total_edits, count(*) FILTER (WHERE e > 0) AS sessions, max(e) AS max_edits, CAST(sum(r) AS BIGINT) AS total_reads FROM p GROUP BY file HAVING sum(e) >= 5) SELECT file, total_edits, sessions, round(total_edits / sessions, 6) AS avg_edits, max_edits, total_reads, round(total_reads / total_edits, 6) AS read_edit_ratio FROM f ORDER BY total_edits DESC, file LIMIT 15")
def file_churn(spark, sf_dir):
    return ses.file_churn(src.log_calls(spark, sf_dir))


@query(f"{_CALLS} SELECT file, count(*) AS reads, count(DISTINCT session_id) AS sessions FROM calls WHERE tool = 'Read' GROUP BY file HAVING count(*) >= 10 AND count(DISTINCT session_id) >= 3 ORDER BY reads DESC, file LIMIT 10")
def frequent_files(spark, sf_dir):
    return ses.frequent_files(src.log_calls(spark, sf_dir))


@query(
    f"""WITH {src.PROMPTS_SQL}, l AS (SELECT *, length(prompt) AS n, row_number() OVER (ORDER BY length(prompt)) AS i, count(*) OVER () AS m FROM prompts)
SELECT count(*) AS prompts, round(avg(n), 6) AS avg_length, max(n) FILTER (WHERE i = m // 2 + 1) AS median_length, count(*) FILTER (WHERE n < 50) AS short, count(*) FILTER (WHERE n >= 50 AND n < 200) AS medium, count(*) FILTER (WHERE n >= 200) AS long,
  count(*) FILTER (WHERE contains(prompt, '?')) AS questions, count(*) FILTER (WHERE regexp_matches(trim(prompt), '{ses.COMMAND.replace("'", "''")}')) AS commands, count(*) FILTER (WHERE regexp_matches(prompt, '{ses.CORRECTION.replace("'", "''")}')) AS corrections,
  round(count(*) FILTER (WHERE regexp_matches(prompt, '{ses.CORRECTION.replace("'", "''")}')) / count(*), 6) AS correction_ratio FROM l"""
)
def prompt_stats(spark, sf_dir):
    return ses.prompt_stats(src.prompts(spark, sf_dir))


@query(
    f"{_CALLS}, p AS (SELECT CASE WHEN grouping(session_id % 10) = 1 THEN 'total' ELSE 'p' || (session_id % 10) END AS project, count(DISTINCT session_id) AS sessions, count(*) AS ai_calls, {_SUMS}, min(day) AS first_day, max(day) AS last_day FROM calls GROUP BY ROLLUP (session_id % 10)) "
    f"SELECT project, sessions, ai_calls, input_tokens, output_tokens, first_day, last_day, round({_WITH_CACHE}, 6) AS est_cost FROM p"
)
def project_rollup(spark, sf_dir):
    """A session's project is the last digit of its id."""
    return ses.project_rollup(src.log_calls(spark, sf_dir).withColumn("project", F.concat(F.lit("p"), (F.col("session_id") % 10).cast("string"))))


@query(
    """WITH t AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM conversations WHERE role IN ('user', 'assistant')),
u AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, g ORDER BY turn ROWS UNBOUNDED PRECEDING) AS nth, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id, g) AS ut FROM t)
SELECT conv_id, turn, CASE WHEN nth = 1 THEN ut END AS user_turn FROM u WHERE role = 'assistant'"""
)
def turn_pairing(spark, sf_dir):
    return ses.turn_pairing(src.table(spark, sf_dir, "conversations"))


# --- debug logs ----------------------------------------------------------------------------------------------------------


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_LOGS = f"""WITH {src.LOG_LINES_SQL},
parsed AS (SELECT session_id, line_no, regexp_extract(line, {_q(logs.LINE)}, 1) AS t, regexp_extract(line, {_q(logs.LINE)}, 2) AS level, regexp_extract(line, {_q(logs.LINE)}, 3) AS m FROM lines WHERE regexp_matches(line, {_q(logs.LINE)})),
kinds AS (SELECT *, CASE WHEN regexp_matches(m, {_q(logs.TOOL_ERROR)}) THEN 'tool_error' WHEN regexp_matches(m, {_q(logs.STALL)}) THEN 'stall' WHEN regexp_matches(m, {_q(logs.API_ERROR)}) THEN 'api_error'
  WHEN regexp_matches(m, {_q(logs.MCP)}) THEN CASE WHEN level = 'ERROR' THEN 'mcp_error' WHEN regexp_matches(m, {_q(logs.MCP_FAILED)}) THEN 'mcp_failed' WHEN regexp_matches(m, {_q(logs.MCP_CONNECTED)}) THEN 'mcp_connected' ELSE 'mcp_info' END
  WHEN regexp_matches(m, {_q(logs.PERMISSION)}) THEN 'permission' WHEN regexp_matches(m, {_q(logs.STARTUP)}) THEN 'startup' ELSE 'other' END AS kind FROM parsed),
found AS (SELECT session_id, line_no, CAST(replace(t, 'Z', '') AS TIMESTAMP) AS ts, level, kind,
  CASE kind WHEN 'tool_error' THEN regexp_extract(m, {_q(logs.TOOL_ERROR)}, 1) WHEN 'api_error' THEN left(regexp_extract(m, {_q(logs.API_ERROR)}, 3), 80) WHEN 'permission' THEN regexp_extract(m, {_q(logs.PERMISSION)}, 2) WHEN 'startup' THEN regexp_extract(m, {_q(logs.STARTUP)}, 1)
    ELSE CASE WHEN kind LIKE 'mcp%' THEN regexp_extract(m, {_q(logs.MCP)}, 1) END END AS name,
  CASE kind WHEN 'tool_error' THEN CAST(regexp_extract(m, {_q(logs.TOOL_ERROR)}, 2) AS DOUBLE) WHEN 'stall' THEN CAST(regexp_extract(m, {_q(logs.STALL)}, 1) AS DOUBLE) WHEN 'permission' THEN CAST(regexp_extract(m, {_q(logs.PERMISSION)}, 1) AS DOUBLE) WHEN 'startup' THEN CAST(regexp_extract(m, {_q(logs.STARTUP)}, 2) AS DOUBLE) END AS amount FROM kinds),
lasts AS (SELECT session_id, kind, name, max_by(amount, line_no) AS amount FROM found WHERE kind IN ('permission', 'startup') GROUP BY session_id, kind, name),
extra AS (SELECT session_id, sum(amount) FILTER (WHERE kind = 'permission') AS allow_rules, sum(amount) FILTER (WHERE kind = 'startup') AS boot_ms FROM lasts GROUP BY session_id),
summary AS (SELECT f.session_id, count(*) FILTER (WHERE level = 'DEBUG') AS n_debug, count(*) FILTER (WHERE level = 'INFO') AS n_info, count(*) FILTER (WHERE level = 'WARN') AS n_warn, count(*) FILTER (WHERE level = 'ERROR') AS n_error,
  count(*) FILTER (WHERE kind = 'tool_error') AS tool_errors, count(*) FILTER (WHERE kind = 'stall') AS stalls, coalesce(sum(amount) FILTER (WHERE kind = 'stall'), 0.0) AS stall_seconds,
  CAST(coalesce(sum(CASE WHEN amount > 200 THEN 15 WHEN amount > 100 THEN 10 WHEN amount > 50 THEN 5 ELSE 2 END) FILTER (WHERE kind = 'stall'), 0) AS BIGINT) AS stall_points, count(*) FILTER (WHERE kind = 'api_error') AS api_errors,
  count(*) FILTER (WHERE kind IN ('mcp_failed', 'mcp_error')) AS mcp_failures, CAST(coalesce(any_value(x.allow_rules), 0) AS BIGINT) AS allow_rules, coalesce(any_value(x.boot_ms), 0.0) AS boot_ms,
  round((epoch_us(max_by(ts, line_no)) - epoch_us(min_by(ts, line_no))) / 3.6e9, 6) AS duration_hours FROM found f LEFT JOIN extra x ON f.session_id = x.session_id GROUP BY f.session_id),
parts AS (SELECT session_id, greatest(0, 100 - 8 * tool_errors) AS tool_reliability, greatest(0, 100 - stall_points) AS streaming_stability, greatest(0, 100 - 15 * api_errors) AS api_reliability,
  CAST(CASE WHEN boot_ms > 5000 THEN 50 WHEN boot_ms > 2000 THEN 75 WHEN boot_ms > 1000 THEN 90 ELSE 100 END AS BIGINT) AS startup_speed, greatest(0, 100 - 20 * mcp_failures) AS mcp_health, tool_errors, api_errors, stalls, stall_seconds, boot_ms FROM summary),
scored AS (SELECT *, CAST(round_even((tool_reliability * 30 + streaming_stability * 20 + api_reliability * 25 + startup_speed * 10 + mcp_health * 15) / 100, 0) AS BIGINT) AS score FROM parts),
health AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM scored)"""


def _log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.events(src.log_lines(spark, sf_dir))


@query(f"{_LOGS} SELECT * FROM summary")
def log_summary(spark, sf_dir):
    return logs.log_summary(_log_events(spark, sf_dir))


@query(f"{_LOGS} SELECT * FROM health")
def session_health(spark, sf_dir):
    return logs.health(logs.log_summary(_log_events(spark, sf_dir)))


_DAY_LOGS = _LOGS.replace("lines AS (SELECT user_id AS session_id,", "all_lines AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id,").replace("AS line FROM ev)", "AS line FROM ev), lines AS (SELECT * FROM all_lines WHERE regexp_matches(line, '\\[(WARN|ERROR)\\]'))", 1)


@query(
    f"""{_DAY_LOGS}, talk AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, count(*) AS ai_calls, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) AS talk_hours FROM ev WHERE k % 9 <> 0 GROUP BY 1)
SELECT coalesce(t.session_id, h.session_id) AS session_id, t.session_id IS NOT NULL AS has_conversation, h.session_id IS NOT NULL AS has_log, coalesce(ai_calls, 0) AS ai_calls, coalesce(talk_hours, duration_hours, 0.0) AS hours,
  coalesce(tool_reliability, 100) AS tool_reliability, coalesce(streaming_stability, 100) AS streaming_stability, coalesce(api_reliability, 100) AS api_reliability, coalesce(startup_speed, 100) AS startup_speed, coalesce(mcp_health, 100) AS mcp_health,
  coalesce(h.tool_errors, 0) AS tool_errors, coalesce(h.api_errors, 0) AS api_errors, coalesce(h.stalls, 0) AS stalls, coalesce(h.stall_seconds, 0.0) AS stall_seconds, coalesce(h.boot_ms, 0.0) AS boot_ms, coalesce(score, 100) AS score, coalesce(grade, 'A') AS grade
  FROM talk t FULL JOIN (SELECT health.*, duration_hours FROM health JOIN summary ON health.session_id = summary.session_id) h ON t.session_id = h.session_id"""
)
def joined_health(spark, sf_dir):
    """A day of a user: its conversation where a call was answered, its log where a line is of level WARN or ERROR, so each side lacks some."""
    talk = ses.session_summary(_by_day(src.log_calls(spark, sf_dir).where("stop_reason <> 'none'")))
    lines = src.log_lines(spark, sf_dir).where(F.col("line").rlike(r"\[(WARN|ERROR)\]"))
    by_day = lines.withColumn("session_id", F.concat(F.col("session_id").cast("string"), F.lit("-"), F.substring("line", 1, 10)))
    return logs.joined_health(talk, logs.log_summary(logs.events(by_day)))


@query(
    f"""{_LOGS} SELECT session_id, 'tool_error' AS category, CASE WHEN count(*) >= 5 THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n, name AS what FROM found WHERE kind = 'tool_error' GROUP BY session_id, name
UNION ALL SELECT session_id, 'api_error', 'high', count(*), name FROM found WHERE kind = 'api_error' GROUP BY session_id, name
UNION ALL SELECT session_id, 'mcp_failure', CASE WHEN count(*) < 3 THEN 'medium' ELSE 'high' END, count(*), name FROM found WHERE kind IN ('mcp_failed', 'mcp_error') GROUP BY session_id, name
UNION ALL SELECT session_id, 'streaming_stall', CASE WHEN stall_seconds / stalls > 120 THEN 'high' ELSE 'medium' END, stalls, 'stalls' FROM summary WHERE stalls > 0
UNION ALL SELECT session_id, 'startup', 'medium', 1, 'startup' FROM summary WHERE boot_ms > 5000"""
)
def friction(spark, sf_dir):
    found = _log_events(spark, sf_dir)
    return logs.friction(found, logs.log_summary(found))


@query(
    f"{_LOGS} SELECT count(*) AS sessions, round_even(avg(score), 1) AS avg_score, min(score) AS min_score, max(score) AS max_score, "
    + ", ".join(f"count(*) FILTER (WHERE grade = '{g}') AS grade_{g.lower()}" for g in "ABCDF")
    + ", CAST(sum(tool_errors) AS BIGINT) AS tool_errors, CAST(sum(api_errors) AS BIGINT) AS api_errors, round(sum(stall_seconds), 6) AS stall_seconds FROM health"
)
def health_rollup(spark, sf_dir):
    return logs.rollup(logs.health(logs.log_summary(_log_events(spark, sf_dir))))


# --- source files and documents ------------------------------------------------------------------------------------------

_MODULES = ["openai", "google.cloud.aiplatform.v1", "langchain_core.messages", "json", "transformers", "os.path", "cohere", "anthropic", "langchain", "mistralai.client"]
_NAMES = ["gpt-4o-mini", "claude-3-opus.", "llama-3-8b", "notes", "gpt-3.5-turbo", "embed-english-v3.0"]


def _source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small source file for each part: an import, a model name, a call and an address."""
    m = F.element_at(F.array(*map(F.lit, _MODULES)), (F.col("p_partkey") % len(_MODULES) + 1).cast("int"))
    n = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    text = F.concat(
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("import "), m)).otherwise(F.concat(F.lit("from "), m, F.lit(" import x"))), F.lit("\nmodel = '"), n, F.lit("'\nx = pd.read_csv('"), F.col("p_name"), F.lit("')\ny = client('"),
        F.when(F.col("p_size") % 2 == 0, "s3").otherwise("sqs"), F.lit("')\nz = 'https://"), F.when(F.col("p_size") % 3 == 0, "example.com").otherwise("api.vendor.io:443"), F.lit("/v1'"),
    )
    return src.table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey")).alias("path"), text.alias("text"))


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_FILES = f"""WITH files AS (SELECT 'f' || p_partkey AS path, CASE WHEN p_partkey % 2 = 0 THEN 'import ' || m ELSE 'from ' || m || ' import x' END || chr(10) || 'model = ''' || n || '''' || chr(10) || 'x = pd.read_csv(''' || p_name || ''')' || chr(10) || 'y = client(''' ||
    CASE WHEN p_size % 2 = 0 THEN 's3' ELSE 'sqs' END || ''')' || chr(10) || 'z = ''https://' || CASE WHEN p_size % 3 = 0 THEN 'example.com' ELSE 'api.vendor.io:443' END || '/v1''' AS text
  FROM (SELECT *, ({_list(_MODULES)})[p_partkey % {len(_MODULES)} + 1] AS m, ({_list(_NAMES)})[p_partkey % {len(_NAMES)} + 1] AS n FROM part)),
lines AS (SELECT path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM files),
imported AS (SELECT path, line_no, coalesce(nullif(regexp_extract(line, '^\\s*from\\s+([\\w.]+)\\s+import\\b', 1), ''), nullif(regexp_extract(line, '^\\s*import\\s+([\\w.]+)', 1), '')) AS module FROM lines),
dim(rank, library, module) AS (VALUES {", ".join(f"({i}, '{lib}', '{m}')" for i, (lib, m) in enumerate((lib, m) for lib, ms in scan.IMPORTS.items() for m in ms))}),
matched AS (SELECT i.path, i.line_no, i.module, min_by(d.library, d.rank) AS library FROM imported i JOIN dim d ON i.module = d.module OR starts_with(i.module, d.module || '.') WHERE i.module IS NOT NULL GROUP BY i.path, i.line_no, i.module)"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.match_modules(scan.imports(scan.lines(_source_files(spark, sf_dir))), scan.dimension(spark, scan.IMPORTS))


@query(f"{_FILES} SELECT path, line_no, module, library FROM matched")
def import_match(spark, sf_dir):
    return _matched(spark, sf_dir)


@query(
    f"{_FILES}, hit AS (SELECT path, line_no, regexp_replace(coalesce({', '.join(f'nullif(regexp_extract(line, {_q(p)}), {chr(39) * 2})' for p in scan.MODELS)}), '[.\\-_]+$', '') AS model FROM lines) "
    "SELECT model, min_by(path, (path, line_no)) AS path, min_by(line_no, (path, line_no)) AS line_no, count(*) AS n FROM hit WHERE model IS NOT NULL GROUP BY model"
)
def model_refs(spark, sf_dir):
    return scan.model_refs(scan.lines(_source_files(spark, sf_dir)))


@query(
    f"""{_FILES} SELECT path, line_no, 'training_data' AS kind, regexp_extract(line, {_q('(' + scan.TRAINING + ')')}, 1) AS what FROM lines WHERE regexp_matches(line, {_q(scan.TRAINING)})
UNION ALL SELECT path, line_no, 'aws', regexp_extract(line, {_q(scan.AWS)}, 1) FROM lines WHERE regexp_matches(line, {_q(scan.AWS)})
UNION ALL SELECT path, line_no, 'url', regexp_extract(regexp_extract(line, {_q(scan.URL)}, 1), '^(?:https?://)?([^/:]*)', 1) FROM lines WHERE regexp_matches(line, {_q(scan.URL)}) AND NOT contains(line, 'example.com')"""
)
def code_calls(spark, sf_dir):
    return scan.code_calls(scan.lines(_source_files(spark, sf_dir)))


@query(f"{_FILES}, f AS (SELECT library, min_by(path, (path, line_no)) AS source FROM matched GROUP BY library), svc(library, destination, role) AS (VALUES {', '.join(f'({_q(k)}, {_q(a)}, {_q(b)})' for k, (a, b) in scan.PROVIDERS.items())}) SELECT f.source, s.destination, f.library, s.role FROM f JOIN svc s ON f.library = s.library")
def service_flows(spark, sf_dir):
    return scan.service_flows(_matched(spark, sf_dir))


_GUIDE_WORDS = ["Article 13 and Annex IV", "inform users of it", "# Article 50", "training data is listed", "# Scope", "retain logs for 6 months", "kept 10 years", "this is not to the provider or deployer", "providers are processor by default", "article 50(2) for the deployer", "Article 12 applies", "plain", "PIP install guide-tool to see"]
_PROMOTION = (r"pip install guide-tool", r"guidetool\s+(run|check)")


def _guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guide for each customer order: its line items pick the lines."""
    word = F.element_at(F.array(*map(F.lit, _GUIDE_WORDS)), (F.col("l_partkey") % len(_GUIDE_WORDS) + 1).cast("int"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return src.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.row_number().over(order).alias("line_no"), word.alias("line"))


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@query(
    f"""WITH g AS (SELECT l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS line_no, ({_list(_GUIDE_WORDS)})[l_partkey % {len(_GUIDE_WORDS)} + 1] AS line FROM lineitem),
e AS (SELECT *, lower(line) AS low, CASE WHEN contains(lower(line), 'article 13') AND (contains(line, '#') OR starts_with(trim(lower(line)), 'article 13')) THEN '13'
  WHEN contains(lower(line), 'article 50') AND (contains(line, '#') OR starts_with(trim(lower(line)), 'article 50')) THEN '50' WHEN starts_with(line, '#') AND NOT contains(lower(line), 'article') THEN '' END AS ev FROM g),
s AS (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section, string_agg(low, ' ') OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS around,
  max(contains(low, 'article 12')) OVER (PARTITION BY path) AS art12, max({_any('low', scan.SCOPE)}) OVER (PARTITION BY path) AS scoped FROM e)
SELECT path, line_no, 'CG-001' AS rule_id, 'error' AS severity FROM s WHERE {_any('low', scan.DISCLOSURE)} AND (contains(low, 'article 13') OR section = '13')
UNION ALL SELECT path, line_no, 'CG-001', 'error' FROM s WHERE {_any('low', scan.TECHNICAL)} AND (contains(low, 'article 50') OR section = '50')
UNION ALL SELECT path, line_no, 'CG-002', 'error' FROM s WHERE {_any('low', scan.RETENTION)} AND contains(low, '6 month') AND NOT contains(around, '10 year') AND NOT contains(around, '10-year')
UNION ALL SELECT path, line_no, 'CG-003', 'error' FROM s WHERE line_no = 1 AND art12 AND NOT scoped
UNION ALL SELECT path, line_no, 'CG-004', 'warning' FROM s WHERE contains(low, 'not to') AND contains(low, 'provider') AND contains(low, 'deployer')
UNION ALL SELECT path, line_no, 'CG-004', 'error' FROM s WHERE contains(low, 'provider') AND contains(low, 'processor') AND contains(low, 'by default')
UNION ALL SELECT path, line_no, 'CG-005', 'error' FROM s WHERE contains(low, 'pip install guide-tool')
UNION ALL SELECT path, line_no, 'CG-006', 'warning' FROM s WHERE contains(low, 'article 50(2)') AND contains(low, 'deployer')"""
)
def lint_lines(spark, sf_dir):
    return scan.lint(_guides(spark, sf_dir), _PROMOTION)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")


def _matches_sql(pattern: str) -> str:
    return f"len(regexp_extract_all(t, {_q(pattern)}))"


_CHECKS = f"""WITH d AS ({{documents}}),
m AS (SELECT path, length(t) AS size, greatest(0, coalesce(list_position(list_transform(l, lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '---') AND NOT starts_with(trim(x), '<!--')), true), 0) - 1) AS f,
  len(list_filter(l, lambda x: regexp_matches(x, '^# [^#]'))) AS h1, len(list_filter(l, lambda x: regexp_matches(x, '^## [^#]'))) AS h2, len(list_filter(l, lambda x: regexp_matches(x, '^### [^#]'))) AS h3,
  len(list_filter(l, lambda x: starts_with(x, '```'))) AS fences, len(list_filter(l, lambda x: length(x) > 500)) AS long, {_matches_sql(scan.TABLE_ROW)} AS table_rows, {_matches_sql(scan.TABLE_RULE)} AS table_rules, {_matches_sql(scan.LINK)} AS links, {_matches_sql(scan.BARE_URL)} AS urls,
  len(list_filter(l, lambda x: regexp_matches(x, '\\S'))) AS filled, len(list_filter(l, lambda x: regexp_matches(x, {_q(scan.PLACEHOLDER)}))) AS open_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '\\S') AND NOT regexp_matches(regexp_replace(x, {_q(scan.EDGES)}, '', 'g'), {_q(scan.STRUCTURE)}))) AS told,
  regexp_matches(t, {_q(scan.TITLE)}) AS titled, regexp_replace(regexp_extract(t, {_q(scan.AFTER_TITLE)}, 1), {_q(scan.EDGES)}, '', 'g') AS after FROM d),
checks AS (SELECT path, 'AF-01' AS check_id, CASE WHEN size <= 50000 THEN 'pass' WHEN size <= 100000 THEN 'warn' ELSE 'fail' END AS status FROM m
UNION ALL SELECT path, 'AF-02', CASE WHEN f <= 5 THEN 'pass' WHEN f <= 20 THEN 'warn' ELSE 'fail' END FROM m
UNION ALL SELECT path, 'AF-03', CASE WHEN h1 + h2 + h3 = 0 THEN 'fail' WHEN h2 >= 5 AND h1 <= 2 THEN 'pass' ELSE 'warn' END FROM m
UNION ALL SELECT path, 'AF-04', CASE WHEN fences % 2 <> 0 THEN 'fail' ELSE 'pass' END FROM m
UNION ALL SELECT path, 'AF-05', CASE WHEN table_rows > 0 AND table_rules = 0 THEN 'fail' ELSE 'pass' END FROM m
UNION ALL SELECT path, 'AF-06', CASE WHEN links > 0 AND urls > links THEN 'warn' ELSE 'pass' END FROM m
UNION ALL SELECT path, 'AF-07', CASE WHEN filled = 0 THEN 'fail' WHEN open_lines * 100 <= 10 * filled THEN 'pass' WHEN open_lines * 100 <= 30 * filled THEN 'warn' ELSE 'fail' END FROM m
UNION ALL SELECT path, 'AF-08', CASE WHEN filled = 0 THEN 'fail' WHEN told * 100 >= 50 * filled THEN 'pass' WHEN told * 100 >= 30 * filled THEN 'warn' ELSE 'fail' END FROM m
UNION ALL SELECT path, 'AF-09', CASE WHEN long = 0 THEN 'pass' WHEN long <= 3 THEN 'warn' ELSE 'fail' END FROM m
UNION ALL SELECT path, 'AF-10', CASE WHEN NOT titled THEN 'fail' WHEN regexp_matches(after, '(?m)^>') OR (after <> '' AND NOT starts_with(after, '#')) THEN 'pass' ELSE 'warn' END FROM m)"""
_PLAIN_CHECKS = _CHECKS.replace("{documents}", "SELECT doc_id AS path, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l FROM documents")
# Documents that the tables' prose lacks: one for each order, of parts that its numbers pick.
_MARKDOWN = ["# Title of it", "A summary that says what it is.", "> Quoted summary", "## Part", "| a | b |", "|---|---|", "| 1 | 2 |", "[text](https://a.example/x)", "see https://b.example/y for more", "[MANUAL INPUT REQUIRED]", "---", "```", "- ", "plain words here", "  "]
_MARKDOWN_CHECKS = _CHECKS.replace("{documents}", f"SELECT path, t, string_split(t, chr(10)) AS l FROM (SELECT l_orderkey AS path, string_agg(({_list(_MARKDOWN)})[l_partkey % {len(_MARKDOWN)} + 1], chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS t FROM lineitem GROUP BY 1)")


@query(f"{_MARKDOWN_CHECKS} SELECT * FROM checks")
def markdown_checks(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, _MARKDOWN)), (F.col("l_partkey") % len(_MARKDOWN) + 1).cast("int"))
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", word.alias("line"))))
    docs = src.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
    return scan.document_checks(docs)


@query(f"{_PLAIN_CHECKS} SELECT * FROM checks")
def document_checks(spark, sf_dir):
    return scan.document_checks(_documents(spark, sf_dir))


@query(f"{_PLAIN_CHECKS} SELECT path, round(avg(CASE status WHEN 'pass' THEN 1.0 WHEN 'warn' THEN 0.5 ELSE 0.0 END) * 100, 4) AS score FROM checks GROUP BY path")
def check_scores(spark, sf_dir):
    return scan.check_scores(scan.document_checks(_documents(spark, sf_dir)))


_NORMAL = "trim(regexp_replace(nfc_normalize({}), '\\s+', ' ', 'g'))"


@query(
    f"""WITH b AS (SELECT item_id * 2 AS quote_id, text FROM benchmark UNION ALL SELECT item_id * 2 + 1, array_to_string(string_split(text, ' ')[2 : 1 + item_id % 12], ' ') FROM benchmark),
q AS (SELECT quote_id, {_NORMAL.format("text")} AS quote FROM b), s AS (SELECT doc_id, {_NORMAL.format("text")} AS text FROM documents),
n AS (SELECT quote_id, count(*) AS n FROM q JOIN s ON contains(s.text, q.quote) WHERE q.quote <> '' GROUP BY quote_id)
SELECT q.quote_id, coalesce(n.n, 0) AS n_sources, CASE WHEN coalesce(quote, '') = '' THEN 'missing-exact-quote' WHEN n.n IS NULL THEN 'exact-quote-not-in-source' ELSE 'ok' END AS finding FROM q LEFT JOIN n ON q.quote_id = n.quote_id"""
)
def quote_findings(spark, sf_dir):
    """Every item of the benchmark as a quote, and its words 2 to 1 + (its id mod 12) as another, so quotes have any number of words from none on."""
    items = src.table(spark, sf_dir, "benchmark")
    part = F.array_join(F.slice(F.split("text", " "), F.lit(2), (F.col("item_id") % 12).cast("int")), " ")
    quotes = items.select(F.explode(F.array(F.struct((F.col("item_id") * 2).alias("quote_id"), F.col("text").alias("quote")), F.struct((F.col("item_id") * 2 + 1).alias("quote_id"), part.alias("quote")))).alias("q")).select("q.*")
    return scan.quote_findings(quotes, src.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"))


_PROVENANCE = """WITH b AS (SELECT *, 'f' || (item_id % 9) AS file, CAST(item_id AS VARCHAR) AS rule_id FROM benchmark),
files AS (SELECT DISTINCT file, item_id % 9 <> 0 AS verified, CASE item_id % 9 WHEN 1 THEN NULL WHEN 2 THEN 'nowhere' ELSE 'd' || (item_id % 9) END AS source FROM b),
sources AS (SELECT 'd' || (item_id % 9) AS source, string_agg(text, chr(10) ORDER BY item_id) AS text FROM b GROUP BY 1),
reqs AS (SELECT file, rule_id, CASE WHEN item_id % 5 = 0 THEN 'organizational' END AS check_type, CASE item_id % 7 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN text || ' never' ELSE text END AS exact_quote FROM b),
fields AS (SELECT rule_id, 'x' AS field_path, item_id % 2 = 0 AS required, CASE item_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'structural' ELSE 'direct' END AS legal_basis, CASE item_id % 6 WHEN 2 THEN NULL WHEN 3 THEN 'not a clause' ELSE left(text, 30) END AS source_quote FROM b),
f AS (SELECT files.file, files.source, sources.text AS st FROM files LEFT JOIN sources ON files.source = sources.source WHERE verified),
r AS (SELECT f.file, f.st, rule_id, check_type, exact_quote FROM f JOIN reqs ON f.file = reqs.file WHERE st IS NOT NULL),
e AS (SELECT r.file, r.st, fields.* FROM r JOIN fields ON r.rule_id = fields.rule_id WHERE coalesce(check_type, '') <> 'organizational')"""


@query(
    f"""{_PROVENANCE} SELECT file, NULL AS rule_id, NULL AS field_path, 'verified-without-source' AS code, 'error' AS severity FROM f WHERE coalesce(source, '') = '' UNION ALL SELECT file, NULL, NULL, 'unknown-source', 'error' FROM f WHERE source <> '' AND st IS NULL
UNION ALL SELECT file, rule_id, NULL, 'missing-exact-quote', 'error' FROM r WHERE coalesce(exact_quote, '') = '' UNION ALL SELECT file, rule_id, NULL, 'empty-exact-quote', 'error' FROM r WHERE trim(exact_quote) = '' UNION ALL SELECT file, rule_id, NULL, 'exact-quote-not-in-source', 'error' FROM r WHERE trim(exact_quote) <> '' AND NOT contains(st, exact_quote)
UNION ALL SELECT file, rule_id, field_path, 'missing-legal-basis', 'warning' FROM e WHERE legal_basis IS NULL AND required UNION ALL SELECT file, rule_id, field_path, 'required-without-direct-basis', 'error' FROM e WHERE legal_basis <> 'direct' AND required
UNION ALL SELECT file, rule_id, field_path, 'direct-basis-missing-source-quote', 'error' FROM e WHERE legal_basis = 'direct' AND source_quote IS NULL UNION ALL SELECT file, rule_id, field_path, 'source-quote-not-in-source', 'error' FROM e WHERE legal_basis = 'direct' AND NOT contains(st, trim(source_quote))"""
)
def provenance_findings(spark, sf_dir):
    """Nine requirement files made of the benchmark's items, whose texts are the files' sources."""
    b = src.table(spark, sf_dir, "benchmark").withColumns({"k": F.col("item_id") % 9, "rule_id": F.col("item_id").cast("string")}).withColumn("file", F.concat(F.lit("f"), "k"))
    k, i = F.col("k"), F.col("item_id")
    files = b.select("file", (k != 0).alias("verified"), F.when(k == 2, "nowhere").when(k != 1, F.concat(F.lit("d"), k)).alias("source")).distinct()
    sources = b.groupBy(F.concat(F.lit("d"), k).alias("source")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    reqs = b.select("file", "rule_id", F.when(i % 5 == 0, "organizational").alias("check_type"), F.when(i % 7 == 1, " ").when(i % 7 == 2, F.concat("text", F.lit(" never"))).when(i % 7 != 0, F.col("text")).alias("exact_quote"))
    fields = b.select("rule_id", F.lit("x").alias("field_path"), (i % 2 == 0).alias("required"), F.when(i % 4 == 1, "structural").when(i % 4 > 1, "direct").alias("legal_basis"), F.when(i % 6 == 3, "not a clause").when(i % 6 != 2, F.left("text", F.lit(30))).alias("source_quote"))
    return scan.validate_quotes(files, reqs, fields, sources)


@query("SELECT page_id, regexp_extract(url, '^(?:https?://)?([^/:]*)', 1) AS domain FROM pages")
def page_domains(spark, sf_dir):
    return src.table(spark, sf_dir, "pages").select("page_id", scan.domain(F.col("url")).alias("domain"))


@query(
    """WITH p AS (SELECT o_custkey AS path, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT path, CAST(n AS INTEGER) AS n_steps, CASE WHEN n <= 3 THEN 'simple' WHEN n <= 8 THEN 'medium' ELSE 'complex' END AS complexity FROM p"""
)
def plan_steps(spark, sf_dir):
    """A plan for each customer: their orders are its steps, under a heading."""
    steps = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: F.concat(F.lit("1. do "), k.cast("string")))
    plans = src.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.concat(F.lit("# Plan\n"), F.array_join(steps, "\n")).alias("text"))
    return scan.plan_steps(plans)


# --- more of sessions ----------------------------------------------------------------------------------------------------


_EFFECT = f"""{_CALLS},{src.USER_TURNS_SQL}, said AS (SELECT session_id, count(*) AS turns, count(*) FILTER (WHERE regexp_matches(prompt, '{ses.DOUBT}')) AS doubts FROM turns GROUP BY session_id),
p AS (SELECT session_id, count(*) AS n, bool_or(coalesce(tool = 'Read' AND file = 'f5', false)) AS reads_it, sum(input_tokens) AS i, sum(output_tokens) AS o, count(*) FILTER (WHERE tool = 'Edit') AS edits, count(DISTINCT CASE WHEN tool = 'Edit' THEN file END) AS files FROM calls GROUP BY session_id HAVING count(*) >= 3),
effect AS (SELECT reads_it, count(*) AS sessions, round(avg(CASE WHEN i > 0 THEN o / i ELSE 0.0 END), 9) AS token_ratio, round(avg(CASE WHEN files > 0 THEN edits / files ELSE 0.0 END), 6) AS edits_per_file,
  round(avg(CASE WHEN turns > 0 THEN doubts / turns ELSE 0.0 END), 6) AS correction_rate FROM p LEFT JOIN said ON p.session_id = said.session_id GROUP BY reads_it)"""


@query(f"{_EFFECT} SELECT * FROM effect")
def doc_read_effect(spark, sf_dir):
    return ses.document_effect(src.log_calls(spark, sf_dir), "f5", turns=src.user_turns(spark, sf_dir))


@query(
    _EFFECT
    + ", m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS metric, (SELECT {c} FROM effect WHERE reads_it) AS with_reads, (SELECT {c} FROM effect WHERE NOT reads_it) AS without_reads" for c in ("correction_rate", "token_ratio", "edits_per_file"))
    + ") SELECT *, round((with_reads - without_reads) / without_reads * 100, 4) AS delta_pct FROM m WHERE with_reads IS NOT NULL AND without_reads > 0"
)
def document_insight(spark, sf_dir):
    return ses.document_insight(ses.document_effect(src.log_calls(spark, sf_dir), "f5", turns=src.user_turns(spark, sf_dir)))


@query(
    f"""{_CALLS}, h AS (SELECT hour(ts) AS h, count(*) AS n FROM calls GROUP BY 1), hh AS (SELECT arg_min(h, (-n, h)) AS peak, coalesce(sum(n) FILTER (WHERE h < 6), 0) / sum(n) * 100 AS night FROM h),
s AS (SELECT session_id, count(*) AS n FROM calls GROUP BY 1), ss AS (SELECT max(n) AS heaviest FROM s), f AS (SELECT file, count(*) FILTER (WHERE tool = 'Edit') AS e FROM calls WHERE file IS NOT NULL GROUP BY file), ff AS (SELECT max(e) AS edits, arg_min(file, (-e, file)) AS edited FROM f),
t AS (SELECT tool, count(*) AS n, min(ord) AS o FROM calls WHERE tool IS NOT NULL GROUP BY tool), tt AS (SELECT arg_min(tool, (-n, o)) AS tool FROM t),
c AS (SELECT count(tool) / count(*) * 100 AS share, sum(cache_read) / sum(input_tokens) * 100 AS cache, count(*) FILTER (WHERE tool = 'Read') / count(*) FILTER (WHERE tool = 'Edit') AS ratio FROM calls),
one AS (SELECT * FROM hh, ss, ff, tt, c)
SELECT 'style' AS pattern, CASE WHEN share > 60 THEN 'builder' WHEN share > 40 THEN 'hybrid' ELSE 'advisor' END AS value FROM one
UNION ALL SELECT 'cache', CASE WHEN cache > 90 THEN 'high' ELSE 'moderate' END FROM one WHERE cache > 50 UNION ALL SELECT 'intensity', CAST(heaviest AS VARCHAR) FROM one UNION ALL SELECT 'iteration', edited FROM one WHERE edits > 20
UNION ALL SELECT 'peak_hour', CAST(peak AS VARCHAR) FROM one UNION ALL SELECT 'night', printf('%.1f', night) FROM one WHERE night > 20 UNION ALL SELECT 'tool', tool FROM one
UNION ALL SELECT 'read_heavy', printf('%.1f', ratio) FROM one WHERE ratio > 1.5 UNION ALL SELECT 'edit_heavy', printf('%.1f', ratio) FROM one WHERE ratio < 0.5"""
)
def workflow_patterns(spark, sf_dir):
    return ses.workflow_patterns(src.log_calls(spark, sf_dir))


@query(
    f"{_CALLS} SELECT coalesce(CASE WHEN ord % 3 = 0 THEN NULL ELSE 'type' || (ord % 4) END, 'general-purpose') AS agent_type, count(*) AS n, count(DISTINCT session_id) AS sessions, round(avg(length(stop_reason || model)), 6) AS avg_prompt, CAST(max(length(stop_reason || model)) AS INTEGER) AS max_prompt FROM calls WHERE tool = 'Agent' GROUP BY 1"
)
def delegation_stats(spark, sf_dir):
    calls = src.log_calls(spark, sf_dir).withColumns({"agent_type": F.when(F.col("ord") % 3 != 0, F.concat(F.lit("type"), (F.col("ord") % 4).cast("string"))), "prompt": F.concat("stop_reason", "model")})
    return ses.delegation_calls(calls)


@query(
    """WITH m AS (SELECT conv_id % 7 AS inbox, role AS sender, conv_id * 1000 + turn AS ord, conv_id AS ts FROM conversations), s AS (SELECT inbox, sender, count(*) AS n, min(ord) AS f FROM m GROUP BY inbox, sender),
t AS (SELECT inbox, arg_min(sender, (-n, f)) AS top_sender, count(*) AS senders FROM s GROUP BY inbox)
SELECT m.inbox, count(*) AS messages, any_value(t.senders) AS senders, any_value(t.top_sender) AS top_sender, arg_min(ts, ord) AS first_time, arg_max(ts, ord) AS last_time FROM m JOIN t ON m.inbox = t.inbox GROUP BY m.inbox"""
)
def inbox_stats(spark, sf_dir):
    m = src.table(spark, sf_dir, "conversations").select((F.col("conv_id") % 7).alias("inbox"), F.col("role").alias("sender"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("conv_id").alias("ts"))
    return ses.inboxes(m)


# --- formats of traces: JSON made of events and read back ----------------------------------------------------------------


def _with_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


_K = "WITH ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


@query(
    f"""{_K}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM ev)
SELECT 't' || user_id AS trace_id, CAST(event_id AS VARCHAR) AS span_id, CASE WHEN k % 2 = 0 THEN 'chat' ELSE 'unknown' END AS operation, 'acme' || (k % 3) AS provider, CASE WHEN k % 2 = 0 THEN 'm' || (k % 4) END AS model_used, CAST(k * 2 AS DOUBLE) AS duration_ms,
  CASE WHEN k % 2 = 0 THEN k END AS input_tokens, CASE WHEN event_type = 'error' THEN 'otel_error' END AS error_type, CASE WHEN k % 2 = 0 THEN 'llm_generation' WHEN k % 3 = 0 THEN 'tool_call' END AS span_kind FROM r"""
)
def otel_ingest(spark, sf_dir):
    """An OTLP export for each event."""
    text = F.format_string(
        '{"resourceSpans":[{"resource":{"attributes":[]},"scopeSpans":[{"spans":[{"traceId":"t%d","spanId":"%d","startTimeUnixNano":"%d000000","endTimeUnixNano":%d000000,"status":{"code":%d},"attributes":[{"key":"gen_ai.system","value":{"stringValue":"acme%d"}}%s%s]}]}]}]}',
        "user_id", "event_id", F.lit(1_700_000_000_000).cast("long"), F.lit(1_700_000_000_000).cast("long") + F.col("k") * 2, F.when(F.col("event_type") == "error", 2).otherwise(1), F.col("k") % 3,
        F.when(F.col("k") % 2 == 0, F.format_string(',{"key":"gen_ai.operation.name","value":{"stringValue":"chat"}},{"key":"gen_ai.response.model","value":{"stringValue":"m%d"}},{"key":"gen_ai.usage.input_tokens","value":{"intValue":"%d"}}', F.col("k") % 4, F.col("k"))).otherwise(""),
        F.when((F.col("k") % 2 != 0) & (F.col("k") % 3 == 0), ',{"key":"gen_ai.tool.name","value":{"stringValue":"search"}}').otherwise(""),
    )
    entries = _with_k(spark, sf_dir).select(F.col("event_id").cast("string").alias("file"), F.lit(0).alias("ord"), text.alias("entry"))
    return traces.otel(entries).select("trace_id", "span_id", "operation", "provider", "model_used", "duration_ms", "input_tokens", "error_type", "span_kind")


@query(
    f"""{_K} SELECT 't' || user_id AS trace_id, CAST(event_id AS VARCHAR) AS span_id, CASE WHEN k % 2 = 0 THEN 'chat' ELSE 'agent' END AS operation, CASE WHEN k % 3 = 0 THEN 'openai' WHEN k % 3 = 1 THEN 'anthropic' END AS provider, CASE WHEN k = 0 THEN NULL ELSE k END AS input_tokens,
  CASE WHEN event_type = 'error' THEN 'error' END AS error_type, CAST(value * 1000 AS DOUBLE) AS duration_ms, CASE WHEN k % 2 = 0 THEN 'llm_generation' WHEN k % 5 = 0 THEN 'agent_handoff' END AS span_kind FROM ev"""
)
def observation_ingest(spark, sf_dir):
    """An observation export for each event."""
    o = F.struct(
        F.col("event_id").cast("string").alias("id"), F.when(F.col("k") % 2 == 0, "GENERATION").otherwise("SPAN").alias("type"), F.when(F.col("k") % 5 == 0, "Delegate work").otherwise("work").alias("name"), F.element_at(F.array(F.lit("gpt-x"), F.lit("claude-x"), F.lit("other")), (F.col("k") % 3 + 1).cast("int")).alias("model"),
        F.col("k").alias("inputTokens"), F.when(F.col("event_type") == "error", "ERROR").alias("level"), F.col("value").alias("latency"),
    )
    entry = F.to_json(F.struct(F.concat(F.lit("t"), F.col("user_id")).alias("id"), F.array(o).alias("observations")))
    entries = _with_k(spark, sf_dir).select(F.col("event_id").cast("string").alias("file"), F.lit(0).alias("ord"), entry.alias("entry"))
    return traces.observations(entries).select("trace_id", "span_id", "operation", "provider", "input_tokens", "error_type", "duration_ms", "span_kind")


@query(
    f"""{_K} SELECT 't' || event_id AS trace_id, 'acme' AS provider, 'm' || (k % 4) AS model_requested, CASE WHEN k % 2 = 0 THEN 'r' || (k % 4) ELSE 'm' || (k % 4) END AS model_used, CASE WHEN k % 2 = 0 THEN k END AS input_tokens, CASE WHEN event_type = 'error' THEN CASE WHEN k % 3 = 0 THEN 'rate_limit' ELSE 'api_error' END END AS error_type,
  CASE WHEN k % 2 = 0 THEN 'stop' END AS finish_reason, value AS duration_ms FROM ev"""
)
def api_log_ingest(spark, sf_dir):
    """An entry of an API log for each event."""
    k, even = F.col("k"), F.col("k") % 2 == 0
    response = F.struct(F.concat(F.lit("r"), k % 4).alias("model"), F.array(F.struct(F.lit("stop").alias("finish_reason"))).alias("choices"), F.struct(k.alias("prompt_tokens")).alias("usage"))
    error = F.struct(F.when(k % 3 == 0, "rate_limit").alias("type"), F.lit("said").alias("message"))
    entry = F.to_json(F.struct(F.concat(F.lit("t"), F.col("event_id")).alias("trace_id"), F.lit("acme").alias("provider"), F.struct(F.concat(F.lit("m"), k % 4).alias("model")).alias("request"), F.when(even, response).alias("response"), F.when(F.col("event_type") == "error", error).alias("error"), F.col("value").alias("latency_ms")))
    entries = _with_k(spark, sf_dir).select(F.col("event_id").cast("string").alias("file"), F.lit(0).alias("ord"), entry.alias("entry"))
    return traces.api_log(entries).select("trace_id", "provider", "model_requested", "model_used", "input_tokens", "error_type", F.get("finish_reasons", 0).alias("finish_reason"), "duration_ms")


@query(
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM conversations WHERE role IN ('user', 'assistant')),
u AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, g ORDER BY turn ROWS UNBOUNDED PRECEDING) AS nth, first_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id, g ORDER BY turn ROWS UNBOUNDED PRECEDING) AS said FROM t)
SELECT 'c' || conv_id AS trace_id, 'u' || conv_id || '-' || turn AS span_id, length(CASE WHEN nth = 1 THEN said END) AS n_input, turn + 10 AS input_tokens, turn + 10 + length(text) AS total_tokens FROM u WHERE role = 'assistant'"""
)
def conversation_ingest(spark, sf_dir):
    """A conversation log for each conversation, an entry for each turn."""
    c = src.table(spark, sf_dir, "conversations")
    usage = F.struct(F.col("turn").alias("input_tokens"), F.lit(10).alias("cache_read_input_tokens"), F.length("text").alias("output_tokens"))
    message = F.struct(F.when(F.col("role") == "assistant", "message").alias("type"), F.col("text").alias("content"), F.when(F.col("role") == "assistant", usage).alias("usage"))
    entry = F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.lit("c"), F.col("conv_id")).alias("sessionId"), F.concat(F.lit("u"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("uuid"), message.alias("message")))
    entries = c.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").cast("int").alias("ord"), entry.alias("entry"))
    return traces.conversations(entries).select("trace_id", "span_id", F.length("input_messages").alias("n_input"), "input_tokens", "total_tokens")


_LINE_TOOLS = "list_transform(range(l_linenumber % 4), lambda i: 'tool' || (l_partkey % 5 + i))"


@query(
    f"""SELECT 'o' || l_orderkey AS trace_id, 'o' || l_orderkey || '-' || l_linenumber AS span_id, array_to_string({_LINE_TOOLS}, ',') AS tools, CASE WHEN l_linenumber % 4 > 0 THEN 'part ' || l_partkey END AS first_arguments, CASE WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS n_evaluations,
  CASE WHEN l_returnflag = 'R' THEN l_quantity END AS score, CASE WHEN l_returnflag = 'R' THEN 'late' WHEN l_returnflag = 'A' THEN 'as told' END AS label, 'supplier ' || l_suppkey AS asked, l_discount AS total_cost FROM lineitem"""
)
def observation_content(spark, sf_dir):
    """An export for each item of an order, wrapped in data, with several tools and scores."""
    li = src.table(spark, sf_dir, "lineitem")
    # text of an entry: what holds a null is null, and concat_ws leaves it out
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    order, number, part, flag, cost = (F.col(f"l_{c}") for c in ("orderkey", "linenumber", "partkey", "returnflag", "discount"))
    tools = F.concat_ws(",", *(F.when(number % 4 > i, text('{"function":{"name":"tool', part % 5 + i, '","arguments":"part ', part, '"}}')) for i in range(3)))
    word = '{"name":"word","value":"none","label":"as told"}'
    quantity = F.concat_ws(",", F.lit('{"name":"quantity"'), text('"value":"', F.col("l_quantity"), '"'), F.lit('"label":"late"}'))
    scores = F.when(flag == "R", text('"scores":[', quantity, f",{word}]")).when(flag == "A", f'"scores":[{word}]')
    number_or_text = F.when(F.abs(cost) < float("inf"), cost.cast("string")).otherwise(text('"', cost, '"'))
    one = F.concat_ws(",", text('"id":"o', order, "-", number, '"'), text('"input":"supplier ', F.col("l_suppkey"), '"'), text('"output":{"tool_calls":[', tools, "]}"), scores, text('"totalCost":', number_or_text))
    entry = text('{"data":[{', F.concat_ws(",", text('"traceId":"o', order, '"'), text('"observations":[{', one, "}]")), "}]}")
    spans = traces.observations(li.select(F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").cast("long").alias("ord"), entry.alias("entry")))
    first = F.get("evaluations", 0)
    return spans.select(
        "trace_id", "span_id", F.coalesce(F.array_join("tool_calls.name", ","), F.lit("")).alias("tools"), F.get("tool_calls", 0)["arguments"].alias("first_arguments"), F.coalesce(F.size("evaluations"), F.lit(0)).alias("n_evaluations"),
        first["score_value"].alias("score"), first["score_label"].alias("label"), F.get("messages_in", 0)["content"].alias("asked"), "total_cost",
    )


@query(
    """WITH t AS (SELECT *, lag(role) OVER w AS before_role, lag(text) OVER w AS before_text, lag(turn) OVER w AS before_turn, first_value(turn) OVER w AS first_turn FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT 'c' || conv_id AS trace_id, 'u' || conv_id || '-' || turn AS span_id, CASE WHEN text <> '' THEN length(text) END AS n_said, CASE WHEN before_role = 'user' THEN CASE WHEN before_turn % 3 = 1 THEN NULL ELSE length(before_text) END END AS n_asked,
  array_to_string(list_transform(range(turn % 3), lambda i: 'tool' || i), ',') AS tools, CASE WHEN turn % 3 > 0 THEN '{"file_path":"f' || turn || '"}' END AS arguments, 'branch' || (first_turn + conv_id % 2) AS branch FROM t WHERE role = 'assistant'"""
)
def conversation_content(spark, sf_dir):
    """A conversation log for each conversation: answers with text and several tools; of what users say, some is a list of blocks, some of these without text."""
    c, turn = src.table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')"), F.col("turn")
    block = lambda kind, text=None, name=None, value=None: F.struct(F.lit(kind).alias("type"), (F.lit(None) if text is None else text).cast("string").alias("text"), (F.lit(None) if name is None else name).cast("string").alias("name"), (F.struct(F.lit(None).cast("string").alias("file_path")) if value is None else F.struct(value.alias("file_path"))).alias("input"))
    uses = F.transform(F.slice(F.array(F.lit(0), F.lit(1)), 1, (turn % 3).cast("int")), lambda i: block("tool_use", name=F.concat(F.lit("tool"), i), value=F.concat(F.lit("f"), turn)))
    blocks = F.when(F.col("role") == "assistant", F.concat(F.array(block("text", F.col("text"))), uses)).when(turn % 3 == 1, F.array(block("tool_result"))).when(turn % 3 == 2, F.array(block("text", F.col("text"))))
    base = (F.col("role").alias("type"), F.concat(F.lit("c"), "conv_id").alias("sessionId"), F.concat(F.lit("u"), "conv_id", F.lit("-"), "turn").alias("uuid"), F.concat(F.lit("branch"), turn + F.col("conv_id") % 2).alias("gitBranch"))
    kind = F.when(F.col("role") == "assistant", "message").alias("type")
    entry = F.when(blocks.isNull(), F.to_json(F.struct(*base, F.struct(kind, F.col("text").alias("content")).alias("message")))).otherwise(F.to_json(F.struct(*base, F.struct(kind, blocks.alias("content")).alias("message"))))
    spans = traces.conversations(c.select(F.col("conv_id").cast("string").alias("file"), turn.alias("ord"), entry.alias("entry")))
    said = lambda m: F.length(F.get(m, 0)["content"])
    return spans.select("trace_id", "span_id", said("messages_out").alias("n_said"), said("messages_in").alias("n_asked"), F.coalesce(F.array_join(F.transform("tool_calls", lambda t: t["name"]), ","), F.lit("")).alias("tools"), F.get("tool_calls", 0)["arguments"].alias("arguments"), F.element_at("metadata", "gitBranch").alias("branch"))


_WRITTEN = ["trace_id", "span_ord", "span_id", "parent_span_id", "operation", "start_time", "duration_ms", "input_tokens", "agent_id"]


@query(f"WITH {src.EVENT_SPANS_SQL} SELECT {', '.join(_WRITTEN)} FROM spans")
def written_traces(spark, sf_dir):
    """All spans, written as nested JSON, an object for each trace of at most three spans or part of a larger one, and read back out of the files."""
    spans, path = src.event_spans(spark, sf_dir).select(*_WRITTEN), own_path(spark, "traces")
    written.write(spans, path, part=3)
    return written.read(traces.load(spark, path, suffixes=".json"), spans.schema)


# --- files ---------------------------------------------------------------------------------------------------------------------


def _conversation_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Four folders with a file of lines each, an entry for each turn of the conversations of a quarter; every seventh turn is no JSON and every fifth line blank."""
    c = src.table(spark, sf_dir, "conversations")
    entry = F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.lit("c"), F.col("conv_id")).alias("sessionId"), F.concat(F.lit("u"), F.col("turn")).alias("uuid"), F.substring("text", 1, 40).alias("said")))
    line = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, "no entry {").when((F.col("conv_id") + F.col("turn")) % 5 == 0, "").otherwise(entry)
    root = own_path(spark, "conversation-files")
    sorted_lines = c.select("conv_id", "turn", (F.col("conv_id") % 4).alias("part"), line.alias("line")).repartition(4, "part").sortWithinPartitions("part", "conv_id", "turn")
    sorted_lines.select("part", "line").write.partitionBy("part").option("compression", "none").text(root)
    return [f"{root}/part={i}" for i in range(4)]


_FILE_LINES = """WITH l AS (SELECT *, conv_id % 4 AS part, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id, turn) AS line_no, (conv_id + turn) % 7 = 0 AS bad, (conv_id + turn) % 5 = 0 AND (conv_id + turn) % 7 <> 0 AS blank FROM conversations)"""


@query(f"{_FILE_LINES} SELECT part, line_no, 'invalid' AS problem FROM l WHERE bad")
def file_problems(spark, sf_dir):
    """Files are cut into pieces of 20 KB, so most numbers of lines are sums over pieces."""
    found = [files.problems(files.trace_lines(spark, x, suffixes=".txt", split=20_000)).withColumn("part", F.lit(i).cast("long")) for i, x in enumerate(_conversation_files(spark, sf_dir))]
    return reduce(DataFrame.unionByName, found).select("part", "line_no", "problem")


@query(f"{_FILE_LINES} SELECT part, 'c' || conv_id AS session_id, count(*) AS n_entries, min_by('u' || turn, line_no) AS first_uuid, max_by('u' || turn, line_no) AS last_uuid FROM l WHERE NOT bad AND NOT blank GROUP BY part, conv_id")
def file_entries(spark, sf_dir):
    """Entries of files of lines in their order, and the format that they are found to have."""
    found = [traces.load(spark, x, suffixes=".txt", split=20_000).withColumn("part", F.lit(i).cast("long")) for i, x in enumerate(_conversation_files(spark, sf_dir))]
    entries = reduce(DataFrame.unionByName, found)
    known = entries.where("entry IS NOT NULL").join(traces.detect(entries).where("source_format = 'claudecode'"), "file")
    of = lambda x: F.get_json_object("entry", x)
    return known.groupBy("part", of("$.sessionId").alias("session_id")).agg(F.count(F.lit(1)).alias("n_entries"), F.min_by(of("$.uuid"), "ord").alias("first_uuid"), F.max_by(of("$.uuid"), "ord").alias("last_uuid"))


@query(
    """WITH f AS (SELECT ['app', 'app/node_modules/x', 'lib', 'x.egg-info'][1 + p_partkey % 4] AS folder, p_name FROM part)
SELECT split_part(folder, '/', 1) AS folder, count(*) AS n_lines, sum(length(p_name) + 1)::BIGINT AS n_chars FROM f WHERE folder IN ('app', 'lib') GROUP BY folder"""
)
def tree_walk(spark, sf_dir):
    """A code base of written files: folders that are skipped are not entered, at any depth."""
    root, parts = own_path(spark, "tree"), src.table(spark, sf_dir, "part")
    for i, folder in enumerate(("app", "app/node_modules/x", "lib", "x.egg-info")):
        parts.where(F.col("p_partkey") % 4 == i).select("p_name").write.option("compression", "none").mode("append").text(f"{root}/{folder}")
    found = files.source_tree(spark, root, suffixes=".txt")
    return found.groupBy(F.get(F.split("inside", "/"), 0).alias("folder")).agg(F.sum(F.size(F.split("text", "\n", -1)) - 1).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


@query(
    """WITH p AS (SELECT ['-home-ann-shop', '-Users-bo-Downloads-web', 'plain', '-'][1 + conv_id % 4] AS raw_name, CASE WHEN conv_id % 4 = 0 THEN strlen('{"cwd":"/srv/ann/store/","turn":' || turn || '}') ELSE strlen('{"turn":' || turn || '}') END + 1 AS size FROM conversations)
SELECT raw_name, CASE raw_name WHEN '-home-ann-shop' THEN 'store' WHEN '-Users-bo-Downloads-web' THEN 'web' ELSE raw_name END AS display_name, CASE raw_name WHEN '-home-ann-shop' THEN '/srv/ann/store/' WHEN '-Users-bo-Downloads-web' THEN '/Users/bo/Downloads/web' WHEN '-' THEN '/' ELSE 'plain' END AS cwd,
  CASE raw_name WHEN '-home-ann-shop' THEN '/srv/ann/store/' WHEN '-Users-bo-Downloads-web' THEN '/Users/bo/Downloads/web/' WHEN '-' THEN '' ELSE 'plain/' END AS prefix, sum(size)::BIGINT AS n_bytes FROM p GROUP BY raw_name"""
)
def project_list(spark, sf_dir):
    """Folders of written session logs: one says where it was run, the others' names tell.

    Only a folder's first log is asked, and Spark's first task writes a file even without a row, so rows are ordered: then the first file has the first of them."""
    root, c = own_path(spark, "projects"), src.table(spark, sf_dir, "conversations")
    for i, folder in enumerate(("-home-ann-shop", "-Users-bo-Downloads-web", "plain", "-")):
        entry = F.to_json(F.struct(*([F.lit("/srv/ann/store/").alias("cwd")] if i == 0 else []), "turn"))
        c.where(F.col("conv_id") % 4 == i).orderBy("conv_id", "turn").select(entry).write.option("compression", "none").text(f"{root}/{folder}")
    return files.projects(spark, root, suffixes=".txt").where("n_bytes > 0").drop("n_sessions")


# --- packs of rules -------------------------------------------------------------------------------------------------------------


def _pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of YAML for each fifty parts, a rule for each part; faults and what a rule says itself follow from its key. Every ninth file is no YAML."""
    k = F.col("p_partkey")
    at = lambda n, yes, no="": F.when(k % n == 0, yes).otherwise(no)
    entry = F.concat(
        F.lit("- id: P"), k.cast("string"), F.lit("\n  description: |\n    of a\n    part\n"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit('  title: "'), "p_name", F.lit('"\n'))), at(5, "  severity: urgent\n", "  severity: recommended\n"), at(4, "  article: own\n"),
        at(3, "  applies_to: [all, multi_agent_only]\n", "  applies_to: [high_risk]\n"), F.lit("  evidence_fields:\n  - {field_path: model_used, description: a}\n"), at(11, "  - {description: b}\n", "  - {field_path: operation, description: b, required: false}\n"),
    )
    n = F.col("file")
    head = F.when(n % 9 == 8, "requirements: [\n").otherwise(F.concat(F.lit("regulation: R"), n % 3, F.lit("\narticle: A"), n, F.when(n % 2 == 0, "\nverified_against_primary: true").otherwise(""), F.lit("\nrequirements:\n")))
    texts = src.table(spark, sf_dir, "part").groupBy((k / 50).cast("int").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), entry.alias("e")))), lambda x: x["e"]), "").alias("body"))
    return packs.parsed(texts.select(F.concat(F.lit("f"), n).alias("path"), F.concat(head, F.col("body")).alias("text")))


_PACK_SQL = "WITH p AS (SELECT p_partkey AS k, p_partkey // 50 AS file, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 1 AS ord, p_name FROM part)"
_PACK_SOUND = "file % 9 <> 8 AND k % 7 <> 0 AND k % 5 <> 0 AND k % 11 <> 0"


@query(
    f"""{_PACK_SQL} SELECT 'f' || file AS file, ord AS rule_ord, 'P' || k AS rule_id, 'R' || (file % 3) AS regulation, CASE WHEN k % 4 = 0 THEN 'own' ELSE 'A' || file END AS article, p_name AS title, 'recommended' AS severity, file % 2 = 0 AS verified
FROM p WHERE {_PACK_SOUND}"""
)
def pack_rules(spark, sf_dir):
    """Rules of YAML files with what they take from their files."""
    return packs.requirements(_pack(spark, sf_dir)).select("file", "rule_ord", "rule_id", "regulation", "article", "title", "severity", "verified")


@query(f"{_PACK_SQL} SELECT 'P' || k AS rule_id, o AS field_ord, CASE o WHEN 0 THEN 'model_used' ELSE 'operation' END AS field_path, o = 0 AS required, 'non_null' AS check_type FROM p, (VALUES (0), (1)) v (o) WHERE {_PACK_SOUND}")
def pack_fields(spark, sf_dir):
    return packs.evidence_fields(_pack(spark, sf_dir)).select("rule_id", "field_ord", "field_path", "required", "check_type")


@query(
    f"""{_PACK_SQL}, f AS (SELECT file, ord, k, unnest([CASE WHEN k % 7 = 0 THEN 'missing required field ''title''' END, CASE WHEN k % 11 = 0 THEN 'evidence_field missing ''field_path''' END, CASE WHEN k % 5 = 0 THEN 'invalid severity ''urgent''' END]) AS fault FROM p WHERE file % 9 <> 8)
SELECT 'f' || file AS file, ord AS rule_ord, 'P' || k AS rule_id, fault FROM f WHERE fault IS NOT NULL UNION ALL SELECT DISTINCT 'f' || file, NULL, NULL, 'YAML parse error' FROM p WHERE file % 9 = 8"""
)
def pack_findings(spark, sf_dir):
    """One finding for each broken field."""
    return packs.findings(_pack(spark, sf_dir))


@query(
    f"""{_PACK_SQL}, kinds AS (SELECT DISTINCT n > 4 AS is_multi_agent FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id))
SELECT is_multi_agent, 'P' || k AS rule_id FROM p, kinds WHERE {_PACK_SOUND} AND (is_multi_agent OR k % 3 <> 0)"""
)
def pack_applicable(spark, sf_dir):
    """Rules about several agents apply only where traces have them; here long conversations stand for those."""
    kinds = src.table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.count(F.lit(1)) > 4).alias("is_multi_agent"))
    return packs.applicable_to(packs.requirements(_pack(spark, sf_dir)), kinds).select("is_multi_agent", "rule_id")


# --- syntax trees ---------------------------------------------------------------------------------------------------------------

# Texts of Python files by kind, and what each imports: line, module, whether the file parses.
_TREES = (
    ("from openai import (\n    x,\n    y,\n)\n", [(1, "openai", True)]),
    ("def f():\n    import os, \\\n        psycopg2.extras\n    return \"gpt-4o \" \"x\"\n", [(2, "os", True), (2, "psycopg2.extras", True)]),
    ("if 1:\n    import google.cloud.bigquery as b; import redis\n", [(2, "google.cloud.bigquery", True), (2, "redis", True)]),
    ("x = '''\nimport faiss\n'''\nimport pinecone\n", [(4, "pinecone", True)]),
    ("import (broken\nimport cohere\n", [(2, "cohere", False)]),
    ("# import anthropic\nimport boto3; boto3.client('s3')\n", [(2, "boto3", True)]),
    ("class A:\n  def f(self):\n    try:\n      from pymongo . collection import (C)\n    except ImportError: import sqlite3\n", [(4, "pymongo.collection", True), (5, "sqlite3", True)]),
)
_TREE_FLOWS = [("ai_provider", "OpenAI API", 0, 1), ("vector_db", "Pinecone", 3, 4), ("database", "Postgresql (psycopg2)", 1, 2), ("database", "Redis (redis)", 2, 2), ("database", "Mongodb (pymongo)", 6, 4), ("database", "Sqlite (sqlite3)", 6, 5), ("cloud", "AZURE openai", 0, 1), ("cloud", "GCP bigquery", 2, 2), ("cloud", "AWS lambda", 5, 2), ("cloud", "AWS s3", 5, 2)]


def _tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(_TREES)], "kind long, start string")
    parts = src.table(spark, sf_dir, "part").withColumn("kind", (F.col("p_partkey") + F.length("p_name")) % len(_TREES))
    return parts.join(F.broadcast(kinds), "kind").select(F.concat(F.lit("f"), "p_partkey", F.lit(".py")).alias("path"), F.concat("start", F.lit("# "), "p_name").alias("text"))


_TREE_SQL = f"WITH f AS (SELECT 'f' || p_partkey || '.py' AS path, (p_partkey + length(p_name)) % {len(_TREES)} AS kind FROM part)"
_TREE_ROWS = ", ".join(f"({i}, {line}, '{module}', {parsed})" for i, (_, found) in enumerate(_TREES) for line, module, parsed in found)


@query(f"{_TREE_SQL} SELECT path, line_no, module, parsed FROM f JOIN (VALUES {_TREE_ROWS}) v (kind, line_no, module, parsed) USING (kind)")
def syntax_imports(spark, sf_dir):
    """Imports that stand in functions, over several lines, beside others and in texts and comments that are none."""
    return syntax.imports(_tree_files(spark, sf_dir)).select("path", "line_no", "module", "parsed")


@query(f"{_TREE_SQL} SELECT path, 4 AS line_no, 'gpt-4o' AS model FROM f WHERE kind = 1")
def syntax_models(spark, sf_dir):
    """A name that only the joined text holds."""
    return syntax.model_refs(_tree_files(spark, sf_dir))


@query(f"{_TREE_SQL} SELECT category, destination, min(path) AS path, any_value(line_no) AS line_no FROM f JOIN (VALUES {', '.join(f"('{c}', '{d}', {k}, {n})" for c, d, k, n in _TREE_FLOWS)}) v (category, destination, kind, line_no) USING (kind) GROUP BY category, destination")
def syntax_flows(spark, sf_dir):
    return syntax.data_flows(syntax.usages(_tree_files(spark, sf_dir))).select("category", "destination", "path", "line_no")


@query(
    f"""{_TREE_SQL}, d AS (SELECT DISTINCT category, destination, kind FROM (VALUES {', '.join(f"('{c}', '{d}', {k})" for c, d, k, _ in _TREE_FLOWS)}) v (category, destination, kind) WHERE kind IN (SELECT kind FROM f))
SELECT destination AS recipient, CASE WHEN category = 'ai_provider' THEN 'AI-powered content generation and analysis' ELSE 'Data persistence and retrieval' END AS purpose, category = 'database' AS own, destination IN ('OpenAI API', 'Pinecone') AS leaves FROM d"""
)
def syntax_records(spark, sf_dir):
    """The record of processing of the flows that a code base's imports mean."""
    found = flows.records_of_processing(syntax.data_flows(syntax.usages(_tree_files(spark, sf_dir))))
    return found.select("recipient", "purpose", F.col("transfers").startswith("Internal").alias("own"), F.col("transfers").contains("Cross-border transfer (US)").alias("leaves"))


# --- code bases ------------------------------------------------------------------------------------------------------------

# One file a part, said once for both engines: ~ is a quote, | a new line.
_CODE = (
    "CASE p_partkey % 3 WHEN 0 THEN 'import openai|' WHEN 1 THEN 'from anthropic import x|' ELSE 'import os|' END, '@app.post(|    ~/chat', p_partkey, '~)|@app.route(~/x~)|f1_score(evaluate (x), accuracy_score)|', "
    "CASE WHEN p_partkey % 5 = 0 THEN 'u = ~https://api.cohere.ai/v1~|' ELSE 'accuracy_score + perplexity|' END, 'm = ~gpt-4~', repeat('|m = ~gpt-4o-mini~', CAST(p_partkey % 16 AS INT))"
)
_SCRIPT = "CASE p_partkey % 3 WHEN 0 THEN 'import ~@langchain/core/runs~|' WHEN 1 THEN 'import a from ~openai~; const b = require(~chromadb~)|' ELSE 'import z from ~left~|' END, 'app.get(~/r', p_partkey, '~, f)', CASE WHEN p_partkey % 5 = 0 THEN '|fetch(~https://api.anthropic.com/v1~)' ELSE '' END"
_INSIDE = "CASE p_partkey % 8 WHEN 0 THEN 'src/app/api/chat/route.ts' WHEN 1 THEN 'src/mod.py' WHEN 2 THEN 'tests/test_mod.py' WHEN 3 THEN 'plugins/mod.py' WHEN 4 THEN 'config.py' WHEN 5 THEN 'requirements.txt' WHEN 6 THEN 'Dockerfile' ELSE 'node_modules/x/index.js' END"
_CONTENT = f"CASE WHEN p_partkey % 8 IN (0, 7) THEN concat({_SCRIPT}) WHEN p_partkey % 8 = 5 THEN concat('# openai|openai==1.', p_partkey, '|langchain-openai>=1|numpy|pinecone') WHEN p_partkey % 8 = 6 THEN concat('FROM x|RUN pip install ', CASE WHEN p_partkey % 3 = 0 THEN 'anthropic' ELSE 'numpy' END) ELSE concat({_CODE}) END"
_REPO_COLUMNS = (f"concat('r', p_partkey, '/', {_INSIDE}) AS path", f"{_INSIDE} AS inside", f"translate({_CONTENT}, '~|', concat(chr(39), chr(10))) AS text")


def _code_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "part").selectExpr(*_REPO_COLUMNS)


_REPO = f"""WITH files AS (SELECT {', '.join(_REPO_COLUMNS)} FROM part),
sources AS (SELECT *, inside LIKE '%.ts' AS is_script, inside IN ('tests/test_mod.py') AS is_test, inside = 'config.py' AS is_config, CASE WHEN inside LIKE 'tests/%' OR inside LIKE 'plugins/%' THEN 'supports' ELSE 'uses' END AS usage_type
  FROM files WHERE regexp_matches(inside, '\\.(py|ts)$')),
cut_up AS (SELECT *, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM sources),
lines AS (SELECT *, lead(line) OVER (PARTITION BY path ORDER BY line_no) AS following FROM cut_up),
mods AS (SELECT path, line_no, coalesce(nullif(regexp_extract(line, '^from (\\w+) import', 1), ''), regexp_extract(line, '^import (\\w+)$', 1)) AS library FROM lines WHERE NOT is_script),
modules AS (SELECT * FROM mods WHERE library IN ('openai', 'anthropic')),
hosts(library, host) AS (VALUES {", ".join(f"({_q(k)}, {_q(v)})" for k, v in code.HOSTS.items())}),
addresses AS (SELECT path, library, min(line_no) AS line_no, any_value(is_script) AS is_script FROM lines, hosts WHERE regexp_matches(line, host) GROUP BY path, library),
packs(rank, known, library, is_store) AS (VALUES {", ".join(f"({i}, {_q(p)}, {_q(lib)}, {store})" for i, (p, lib, store) in enumerate([(p, lib, 'false') for lib, ps in code.SCRIPT_PACKAGES.items() for p in ps] + [(p, lib, 'true') for lib, ps in code.SCRIPT_STORES.items() for p in ps]))}),
named AS (SELECT path, line_no, unnest({" || ".join(f"regexp_extract_all(line, {_q(p)}, 1)" for p in code.SCRIPT_IMPORTS)}) AS package FROM lines WHERE is_script),
packages AS (SELECT n.path, n.line_no, n.package, arg_min(p.library, (p.known <> n.package, p.rank)) AS library, arg_min(p.is_store, (p.known <> n.package, p.rank)) AS is_store FROM named n JOIN packs p ON n.package = p.known OR starts_with(n.package, p.known || '/') GROUP BY n.path, n.line_no, n.package),
declared AS (SELECT path, line_no, line FROM (SELECT path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM files WHERE inside = 'requirements.txt') WHERE line NOT LIKE '#%'),
dependencies AS (SELECT path, line_no, 'openai' AS library, 'openai' AS package FROM declared WHERE contains(line, 'openai')),
metrics(i, name, pattern) AS (VALUES {", ".join(f"({i}, {_q(k)}, {_q(v)})" for i, (k, v) in enumerate(code.METRICS.items()))})"""


@query(f"{_REPO} SELECT path, inside, is_script, is_test, is_config, usage_type FROM sources")
def source_kinds(spark, sf_dir):
    return code.classified(code.source_files(_code_base(spark, sf_dir))).drop("text")


@query(f"{_REPO}, seen AS (SELECT path, name, min((line_no, i)) AS first_at FROM lines, metrics WHERE regexp_matches(line, pattern) GROUP BY path, name) SELECT path, string_agg(name, ',' ORDER BY first_at) AS metrics FROM seen GROUP BY path")
def code_metrics(spark, sf_dir):
    return code.metrics(code.lines(code.source_files(_code_base(spark, sf_dir)))).withColumn("metrics", F.array_join("metrics", ","))


@query(f"{_REPO} SELECT path, library, line_no FROM addresses")
def provider_addresses(spark, sf_dir):
    return code.provider_addresses(code.lines(code.source_files(_code_base(spark, sf_dir))))


@query(f"{_REPO} SELECT path, line_no, package, library, is_store FROM packages")
def script_imports(spark, sf_dir):
    return code.script_imports(code.lines(code.source_files(_code_base(spark, sf_dir)).where("is_script")))


@query(
    f"""{_REPO}, found AS (SELECT path, library, line_no FROM modules UNION ALL SELECT path, library, line_no FROM addresses UNION ALL SELECT path, library, line_no FROM packages WHERE NOT is_store),
firsts AS (SELECT f.path, f.library, min(f.line_no) AS line_no, s.usage_type FROM found f JOIN sources s ON f.path = s.path GROUP BY f.path, f.library, s.usage_type)
SELECT * FROM firsts UNION ALL SELECT path, library, min(line_no), 'uses' FROM dependencies GROUP BY path, library"""
)
def code_imports(spark, sf_dir):
    return code.ai_imports(_code_base(spark, sf_dir))


_ROUTE_SQL = f"nullif(regexp_extract({{}}, {_q(code.ROUTE)}, 1), '')"


@query(
    f"""{_REPO}, scripts AS (SELECT path FROM packages WHERE NOT is_store UNION SELECT path FROM addresses WHERE is_script)
SELECT path, CASE WHEN contains(line, 'route') THEN 'flask' ELSE 'fastapi' END AS framework, coalesce({_ROUTE_SQL.format('line')}, {_ROUTE_SQL.format('following')}, '[unknown]') AS route, line_no FROM lines WHERE starts_with(line, '@app') AND path IN (SELECT path FROM modules)
UNION ALL SELECT path, 'express', {_ROUTE_SQL.format('line')}, line_no FROM lines WHERE is_script AND starts_with(line, 'app.get') AND path IN (SELECT path FROM scripts)
UNION ALL SELECT path, 'nextjs', '/api/chat', 1 FROM sources WHERE is_script AND path IN (SELECT path FROM scripts)"""
)
def code_endpoints(spark, sf_dir):
    return code.endpoints(_code_base(spark, sf_dir))


@query(f"{_REPO} SELECT path, CASE inside WHEN 'Dockerfile' THEN 'dockerfile' ELSE 'requirements' END AS config_type, contains(text, 'anthropic') OR contains(text, 'openai') AS contains_ai FROM files WHERE inside IN ('Dockerfile', 'requirements.txt')")
def deployment_files(spark, sf_dir):
    return code.deployments(_code_base(spark, sf_dir))


@query(f"{_REPO} SELECT * FROM dependencies")
def declared_dependencies(spark, sf_dir):
    return code.dependencies(_code_base(spark, sf_dir))


@query(
    f"""{_REPO}, hits AS (SELECT path, line_no, nullif(regexp_extract(line, '~(gpt-[^~]*)~', 1), '') AS model, count(nullif(regexp_extract(line, '~(gpt-[^~]*)~', 1), '')) OVER (PARTITION BY path) AS m FROM (SELECT * REPLACE (replace(line, chr(39), '~') AS line) FROM lines) WHERE NOT is_test AND NOT is_config)
SELECT model, arg_min(path, (path, line_no)) AS path, arg_min(line_no, (path, line_no)) AS line_no, count(*) AS n FROM hits WHERE model IS NOT NULL AND m <= 10 GROUP BY model"""
)
def used_models(spark, sf_dir):
    return code.used_models(_code_base(spark, sf_dir))


# --- flows, filters, paths -------------------------------------------------------------------------------------------------

_FLOWS = (
    "o_orderkey AS flow_ord", "concat('svc', o_custkey % 40) AS destination",
    "CASE o_orderkey % 6 WHEN 0 THEN 'inference' WHEN 1 THEN 'storage' WHEN 2 THEN 'training' WHEN 3 THEN 'monitoring' WHEN 4 THEN 'api_call' ELSE 'archive' END AS purpose",
    "CASE o_custkey % 7 WHEN 0 THEN 'prompts' WHEN 1 THEN 'embeddings' WHEN 2 THEN 'user_data' WHEN 3 THEN 'model_responses' WHEN 4 THEN 'model_data' WHEN 5 THEN 'logs' ELSE 'sounds' END AS data_type",
    "CASE WHEN o_custkey % 3 = 0 THEN 'controller' ELSE 'processor' END AS role", "CASE WHEN o_orderkey % 5 = 0 THEN 'see contract' WHEN o_orderkey % 5 = 1 THEN '' END AS note",
    "CASE WHEN o_orderkey % 4 = 0 THEN 'US' END AS jurisdiction", "o_orderkey % 2 = 0 AS needs_safeguards",
)
_FLOWS_SQL = f"WITH flows AS (SELECT {', '.join(_FLOWS)} FROM orders)"


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "orders").selectExpr(*_FLOWS)


def _told_sql(column: str, texts: dict[str, str], other: str) -> str:
    fill = lambda t: _q(t).replace("{data_type}", "' || data_type || '").replace("{destination}", "' || destination || '")
    return f"CASE {column} " + " ".join(f"WHEN {_q(k)} THEN {fill(v)}" for k, v in texts.items()) + f" ELSE {fill(other) if '{' in other else other} END"


@query(
    f"""{_FLOWS_SQL}, firsts AS (SELECT * FROM flows QUALIFY row_number() OVER (PARTITION BY destination, purpose ORDER BY flow_ord) = 1)
SELECT destination AS recipient, {_told_sql('purpose', flows.ACTIVITIES, flows.OTHER_ACTIVITY)} AS activity, {_told_sql('purpose', flows.PURPOSES, 'purpose')} AS purpose, {_told_sql('data_type', flows.CATEGORIES, 'data_type')} AS data_categories,
  CASE WHEN role = 'controller' THEN {_q(flows.INTERNAL)} ELSE 'Transfer to ' || destination || '; ' || CASE WHEN note <> '' THEN note ELSE replace({_q(flows.USUAL_ROLE)}, '{{role}}', role) END || CASE WHEN needs_safeguards THEN '; ' || replace({_q(flows.SAFEGUARDS)}, '{{jurisdiction}}', coalesce(jurisdiction, 'non-EEA')) ELSE '' END END AS transfers FROM firsts"""
)
def records_of_processing(spark, sf_dir):
    return flows.records_of_processing(_flows(spark, sf_dir))


@query(f"{_FLOWS_SQL}, services AS (SELECT DISTINCT concat('svc', c_custkey % 45) AS service FROM customer) SELECT service, min_by(role, flow_ord) AS first_role, max_by(purpose, flow_ord) AS last_purpose FROM services LEFT JOIN flows ON service = destination GROUP BY service")
def service_roles(spark, sf_dir):
    services = src.table(spark, sf_dir, "customer").selectExpr("concat('svc', c_custkey % 45) AS service").distinct()
    return flows.service_roles(services, _flows(spark, sf_dir))


_SINCE, _UNTIL = "2024-01-05", "2024-01-20"


@query(f"{_CALLS} SELECT session_id, strftime(min(ts), '%Y-%m-%d') AS day, count(*) AS ai_calls FROM calls GROUP BY session_id, date_trunc('day', ts) HAVING strftime(min(ts), '%Y-%m-%d') >= '{_SINCE}' AND strftime(min(ts), '%Y-%m-%d') < '{_UNTIL}'")
def sessions_within(spark, sf_dir):
    days = src.log_calls(spark, sf_dir).groupBy("session_id", "day").agg(F.count(F.lit(1)).alias("ai_calls"))
    return ses.within(days, ses.first_day(since=_SINCE), ses.first_day(since=_UNTIL))


@query(
    f"""{_LOGS}, newest AS (SELECT max_by(session_id, (t, session_id)) AS session_id FROM (SELECT session_id, max(ts) AS t FROM found GROUP BY session_id)), total AS (SELECT session_id, CAST(sum(amount) AS BIGINT) AS total_rules, count(*) AS sources FROM lasts WHERE kind = 'permission' AND session_id = (SELECT session_id FROM newest) GROUP BY session_id)
SELECT *, CASE WHEN total_rules > 100 THEN 'many' WHEN total_rules > 50 THEN 'moderate' ELSE 'lean' END AS size FROM total WHERE total_rules > 0"""
)
def permission_insight(spark, sf_dir):
    return logs.permission_insight(_log_events(spark, sf_dir))


@query(f"{_SPANS}{_PENALTY} SELECT agent, round(max_by(final_score, trace_id), 6) AS final_score FROM solved GROUP BY agent")
def merged_agent_scores(spark, sf_dir):
    return dag.merged(_agent_scores(spark, sf_dir)).withColumn("final_score", F.round("final_score", 6))


def _shown(covered: DataFrame) -> DataFrame:
    return covered.withColumns({"coverage": F.round("coverage", 9), "samples": F.array_join("samples", "|")})


_PATHS = [("props.k", "non_null"), ("props.none", "non_null"), ("props.k.deep", "non_null"), ("other.k", "non_null"), ("event_type", "non_empty")]


@query(
    """WITH n AS (SELECT count(*) AS n, count(json_extract_string(props, '$.k')) AS k, count(nullif(event_type, '')) AS e FROM events), r AS (SELECT 'props.k' AS field, 'non_null' AS check_type, n AS population, k AS present_count FROM n UNION ALL SELECT 'props.none', 'non_null', n, 0 FROM n
UNION ALL SELECT 'props.k.deep', 'non_null', n, 0 FROM n UNION ALL SELECT 'other.k', 'non_null', 0, 0 UNION ALL SELECT 'event_type', 'non_empty', n, e FROM n), s AS (SELECT 'props.k' AS field, string_agg(v, '|' ORDER BY event_id) AS samples FROM (SELECT event_id, json_extract_string(props, '$.k') AS v FROM events WHERE v IS NOT NULL ORDER BY event_id LIMIT 5)
UNION ALL SELECT 'event_type', string_agg(event_type, '|' ORDER BY event_id) FROM (SELECT event_id, event_type FROM events WHERE event_type <> '' ORDER BY event_id LIMIT 5)) SELECT r.*, CASE WHEN population > 0 THEN round(present_count / population, 9) ELSE 0.0::DOUBLE END AS coverage, coalesce(samples, '') AS samples FROM r LEFT JOIN s ON r.field = s.field"""
)
def nested_coverage(spark, sf_dir):
    return _shown(cov.path_samples(src.table(spark, sf_dir, "events"), _PATHS, ["event_id"]))


@query(
    f"""WITH {src.EVENT_SPANS_SQL}, t AS (SELECT trace_id, min(CASE WHEN user_id % 3 > 0 THEN agent_framework END) AS framework FROM spans GROUP BY trace_id), n AS (SELECT count(*) AS n, count(framework) AS f FROM t),
r AS (SELECT 'trace_id' AS field, 'non_empty' AS check_type, n AS population, n AS present_count FROM n UNION ALL SELECT 'metadata.framework', 'non_null', n, f FROM n UNION ALL SELECT 'metadata.none', 'non_null', n, 0 FROM n),
s AS (SELECT 'trace_id' AS field, string_agg(v, '|' ORDER BY v) AS samples FROM (SELECT trace_id AS v FROM t ORDER BY v LIMIT 5) UNION ALL SELECT 'metadata.framework', string_agg(framework, '|' ORDER BY v) FROM (SELECT trace_id AS v, framework FROM t WHERE framework IS NOT NULL ORDER BY v LIMIT 5))
SELECT r.*, round(present_count / population, 9) AS coverage, coalesce(samples, '') AS samples FROM r LEFT JOIN s ON r.field = s.field"""
)
def trace_coverage(spark, sf_dir):
    one = src.event_spans(spark, sf_dir).groupBy("trace_id").agg(F.min(F.when(F.col("user_id") % 3 > 0, F.col("agent_framework"))).alias("framework"))
    traced = one.select("trace_id", F.create_map(F.lit("framework"), F.col("framework")).alias("metadata"))
    return _shown(cov.path_samples(traced, [("trace_id", "non_empty"), ("metadata.framework", "non_null"), ("metadata.none", "non_null")], ["trace_id"]))
