"""Health of sessions from their debug logs: line grammar, summaries, component scores, friction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The log's line grammar. Classes are tried in this order.
LINE = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z)\s+\[(\w+)\]\s+(.*)"
TOOL_ERROR = r"(\w+) tool error \((\d+)ms\): (.*)"
STALL = r"Streaming stall detected: ([\d.]+)s gap between events \(stall #(\d+)\)"
API_ERROR = r"API error \(attempt (\d+)/(\d+)\): (.+)"
MCP = r'MCP server "([^"]+)"[:\s]+(.*)'
MCP_FAILED = r"(connection failed after|failed after) (\d+)ms: (.*)"
MCP_CONNECTED = r"connected after (\d+)ms"
PERMISSION = r"Applying permission update: Adding (\d+) allow rule\(s\) to destination '(\w+)'"
STARTUP = r"\[STARTUP\] (\w[\w()]*) completed in (\d+)ms"
MCP_LOADED = r"\[STARTUP\] MCP configs loaded in (\d+)ms"
# Points off, weights and grades.
PER_TOOL_ERROR, PER_API_ERROR, PER_MCP_FAILURE = 8, 15, 20
STALL_POINTS = ((200, 15), (100, 10), (50, 5), (0, 2))
WEIGHTS = {"tool_reliability": 30, "streaming_stability": 20, "api_reliability": 25, "startup_speed": 10, "mcp_health": 15}
GRADES = ((90, "A"), (75, "B"), (60, "C"), (40, "D"))


def events(lines: DataFrame) -> DataFrame:
    """session_id, line_no, ts, level, kind, name, amount of the lines that fit the grammar. A line is of the first class that it fits;
    a failed server overrides a connected one, and the level ERROR overrides both."""
    part = lambda p, i: F.regexp_extract("message", p, i)
    of = lambda p: F.col("message").rlike(p)
    base = lines.where(F.col("line").rlike(LINE)).select("session_id", "line_no", *(F.regexp_extract("line", LINE, i).alias(n) for i, n in ((1, "ts"), (2, "level"), (3, "message"))))
    event = lambda kind, name=None, amount=None: F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.lit(None) if name is None else name).cast("string").alias("name"), (F.lit(None) if amount is None else amount).cast("string").alias("amount"))
    mcp = F.when(F.col("level") == "ERROR", "mcp_error").when(part(MCP, 2).rlike(MCP_FAILED), "mcp_failed").when(part(MCP, 2).rlike(MCP_CONNECTED), "mcp_connected").otherwise("mcp_info")
    classes = (
        (TOOL_ERROR, event("tool_error", part(TOOL_ERROR, 1), part(TOOL_ERROR, 2))), (STALL, event("stall", amount=part(STALL, 1))), (API_ERROR, event("api_error", F.substring(part(API_ERROR, 3), 1, 80))), (MCP, event(mcp, part(MCP, 1))),
        (PERMISSION, event("permission", part(PERMISSION, 2), part(PERMISSION, 1))), (STARTUP, event("startup", part(STARTUP, 1), part(STARTUP, 2))), (MCP_LOADED, event("startup", F.lit("mcp_load"), part(MCP_LOADED, 1))),
    )
    first = F.coalesce(*(F.when(of(p), e) for p, e in classes), event("other"))
    # a generator's columns are made once, however often what follows reads them
    out = base.select("session_id", "line_no", "ts", "level", F.inline(F.array(first)))
    return out.withColumns({"ts": F.try_to_timestamp("ts"), "amount": F.col("amount").try_cast("double")})


def log_summary(found: DataFrame) -> DataFrame:
    """Of each session: lines by level, first and last time in line order, errors, stalls, and the last value of each permission source and startup part."""
    n = lambda c: F.count_if(c)
    level = lambda x: n(F.col("level") == x).alias(f"n_{x.lower()}")
    kind = lambda *k: n(F.col("kind").isin(*k))
    last = found.where(F.col("kind").isin("permission", "startup")).groupBy("session_id", "kind", "name").agg(F.max_by("amount", "line_no").alias("amount"))
    sums = last.groupBy("session_id").agg(F.sum(F.when(F.col("kind") == "permission", F.col("amount"))).alias("allow_rules"), F.sum(F.when(F.col("kind") == "startup", F.col("amount"))).alias("boot_ms"))
    one = found.groupBy("session_id").agg(
        *(level(x) for x in ("DEBUG", "INFO", "WARN", "ERROR")), F.min_by("ts", "line_no").alias("a"), F.max_by("ts", "line_no").alias("b"),
        kind("tool_error").alias("tool_errors"), kind("stall").alias("stalls"), F.sum(F.when(F.col("kind") == "stall", F.col("amount")).otherwise(0.0)).alias("stall_seconds"),
        F.sum(F.when(F.col("kind") == "stall", stall_points(F.col("amount"))).otherwise(0)).alias("stall_points"), kind("api_error").alias("api_errors"), kind("mcp_failed", "mcp_error").alias("mcp_failures"),
    )
    out = one.join(sums, "session_id", "left")
    duration = F.round((F.unix_micros("b") - F.unix_micros("a")) / 3.6e9, 6)
    return out.withColumns({"allow_rules": F.coalesce("allow_rules", F.lit(0.0)).cast("long"), "boot_ms": F.coalesce("boot_ms", F.lit(0.0)), "duration_hours": duration}).drop("a", "b")


def stall_points(seconds: Column) -> Column:
    out = F.lit(STALL_POINTS[-1][1])
    for least, points in reversed(STALL_POINTS[:-1]):
        out = F.when(seconds > least, points).otherwise(out)
    return out


def health(summary: DataFrame, *beside: str) -> DataFrame:
    """Component scores of each session, their weighted mean rounded half to even, and its grade; the columns named beside are kept."""
    floor0 = lambda c: F.greatest(F.lit(0), c)
    parts = {
        "tool_reliability": floor0(100 - PER_TOOL_ERROR * F.col("tool_errors")), "streaming_stability": floor0(100 - F.col("stall_points")), "api_reliability": floor0(100 - PER_API_ERROR * F.col("api_errors")),
        "startup_speed": F.when(F.col("boot_ms") > 5000, 50).when(F.col("boot_ms") > 2000, 75).when(F.col("boot_ms") > 1000, 90).otherwise(100), "mcp_health": floor0(100 - PER_MCP_FAILURE * F.col("mcp_failures")),
    }
    out = summary.select("session_id", *(v.cast("long").alias(k) for k, v in parts.items()), "tool_errors", "api_errors", "stalls", "stall_seconds", "boot_ms", *beside)
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0))
    out = out.withColumn("score", F.bround(total / sum(WEIGHTS.values()), 0).cast("long"))
    grade = F.lit("F")
    for least, letter in reversed(GRADES):
        grade = F.when(F.col("score") >= least, letter).otherwise(grade)
    return out.withColumn("grade", grade)


def joined_health(sessions: DataFrame, summary: DataFrame) -> DataFrame:
    """health() of all sessions that a conversation, a debug log or both are there for: session_id, has_conversation, has_log, the columns of health(), ai_calls and hours.

    The log's components have no ground where there is no log, so all of them are whole and the score is that of the conversation's side alone: 100, grade A.
    hours are the conversation's, else the log's. Sessions of a null id are kept apart from each other, as nothing says that they are the same."""
    left = sessions.select("session_id", F.lit(True).alias("has_conversation"), "ai_calls", F.col("duration_hours").alias("talk_hours"))
    right = summary.withColumn("has_log", F.lit(True)).withColumnRenamed("duration_hours", "log_hours")
    both = left.join(right, "session_id", "full_outer")
    counts = ("tool_errors", "api_errors", "stalls", "stall_points", "mcp_failures", "stall_seconds", "boot_ms", "ai_calls")
    filled = both.na.fill(0, list(counts)).na.fill(False, ["has_conversation", "has_log"]).withColumn("hours", F.coalesce("talk_hours", "log_hours", F.lit(0.0)))
    return health(filled, "has_conversation", "has_log", "ai_calls", "hours")


def friction(found: DataFrame, summary: DataFrame) -> DataFrame:
    """session_id, category, severity, n, what: one row for each tool, for stalls, for each API message, for a slow start, for each failing server."""
    by = lambda kinds, category, severity: found.where(F.col("kind").isin(*kinds)).groupBy("session_id", F.col("name").alias("what")).agg(F.count(F.lit(1)).alias("n")).select("session_id", F.lit(category).alias("category"), severity.alias("severity"), "n", "what")
    tools = by(("tool_error",), "tool_error", F.when(F.col("n") >= 5, "high").when(F.col("n") >= 2, "medium").otherwise("low"))
    api = by(("api_error",), "api_error", F.lit("high"))
    servers = by(("mcp_failed", "mcp_error"), "mcp_failure", F.when(F.col("n") < 3, "medium").otherwise("high"))
    stalls = summary.where("stalls > 0").select("session_id", F.lit("streaming_stall").alias("category"), F.when(F.col("stall_seconds") / F.col("stalls") > 120, "high").otherwise("medium").alias("severity"), F.col("stalls").alias("n"), F.lit("stalls").alias("what"))
    slow = summary.where("boot_ms > 5000").select("session_id", F.lit("startup").alias("category"), F.lit("medium").alias("severity"), F.lit(1).cast("long").alias("n"), F.lit("startup").alias("what"))
    return tools.unionByName(api).unionByName(servers).unionByName(stalls).unionByName(slow)


def rollup(scores: DataFrame) -> DataFrame:
    grades = [F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABCDF"]
    return scores.agg(F.count(F.lit(1)).alias("sessions"), F.bround(F.avg("score"), 1).alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), *grades, F.sum("tool_errors").alias("tool_errors"), F.sum("api_errors").alias("api_errors"), F.round(F.sum("stall_seconds"), 6).alias("stall_seconds"))


def permission_insight(found: DataFrame) -> DataFrame:
    """session_id, total_rules, sources, size of the newest log with permission rules: the last count of each source; over 100 rules are many, over 50 moderate."""
    newest = found.groupBy("session_id").agg(F.max("ts").alias("last_ts")).agg(F.max_by("session_id", F.struct("last_ts", "session_id")).alias("session_id"))  # one row
    rules = found.where("kind = 'permission'").join(F.broadcast(newest), "session_id")
    by_source = rules.groupBy("session_id", "name").agg(F.max_by("amount", "line_no").cast("long").alias("n"))
    one = by_source.groupBy("session_id").agg(F.sum("n").alias("total_rules"), F.count(F.lit(1)).alias("sources")).where("total_rules > 0")
    return one.withColumn("size", F.when(F.col("total_rules") > 100, "many").when(F.col("total_rules") > 50, "moderate").otherwise("lean"))
