"""Analytics of coding sessions: usage, cost, forecasts, context pressure, files, prompts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Dollars a million tokens.
PRICE_INPUT, PRICE_OUTPUT, PRICE_CACHE_READ, PRICE_CACHE_CREATE = 15.0, 75.0, 1.5, 18.75
# Patterns of prompts.
CORRECTION = r"(?i)\b(no[,.]?\s+(not that|I meant|don'?t|instead)|that'?s wrong|undo that|revert|go back|actually[,.]?\s+(I want|let'?s|do)|wait[,.]?\s+no|never\s*mind|scratch that|stop[,.]?\s+(don'?t|no)|wrong approach)\b"
DOUBT = r"(?i)\b(no[,.]|wrong|undo|revert|actually[,.])\b"  # the looser one of the comparison of sessions by a document
COMMAND = r"(?i)^(create|build|write|add|remove|delete|fix|update|change|move|rename|install|run|deploy|push|commit|implement|refactor|make|set up|configure)\b"
# Session lengths in hours.
LENGTHS = (("< 30min", 0.0, 0.5), ("30min-1h", 0.5, 1.0), ("1-2h", 1.0, 2.0), ("2-4h", 2.0, 4.0), ("4-8h", 4.0, 8.0), ("8h+", 8.0, 999.0))


def hours(first: Column, last: Column) -> Column:
    return (F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 3.6e9


def session_summary(calls: DataFrame) -> DataFrame:
    """Of each session: calls, tokens, its most used tool (of equals the first used), hours, models, first day."""
    tools = calls.where(F.col("tool").isNotNull()).groupBy("session_id", "tool").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    top = tools.groupBy("session_id").agg(F.min_by("tool", F.struct(-F.col("n"), F.col("first_ord"))).alias("top_tool"), F.sum("n").alias("tool_calls"))
    sums = calls.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("ai_calls"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_create")),
        F.min("ts").alias("a"), F.max("ts").alias("b"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
    )
    return sums.join(top, "session_id", "left").select("session_id", F.date_format("a", "yyyy-MM-dd").alias("day"), "ai_calls", "input_tokens", "output_tokens", "cache_read", "cache_create", F.coalesce("tool_calls", F.lit(0)).alias("tool_calls"), F.coalesce("top_tool", F.lit("-")).alias("top_tool"), F.round(hours(F.col("a"), F.col("b")), 6).alias("duration_hours"), "models")


def cost_columns(fresh_floor: bool = False) -> dict[str, Column]:
    """Cost with caching and without, of summed tokens. fresh_floor: fresh input counts as 0 at least."""
    i, o, r, c = (F.col(x).cast("double") for x in ("input_tokens", "output_tokens", "cache_read", "cache_create"))
    fresh = i - r - c
    fresh = F.greatest(F.lit(0.0), fresh) if fresh_floor else fresh
    return {"cost_no_cache": i / 1e6 * PRICE_INPUT + o / 1e6 * PRICE_OUTPUT, "cost_with_cache": fresh / 1e6 * PRICE_INPUT + c / 1e6 * PRICE_CACHE_CREATE + r / 1e6 * PRICE_CACHE_READ + o / 1e6 * PRICE_OUTPUT}


def totals(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count(F.lit(1)).alias("ai_calls"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_create")))


def cost_breakdown(calls: DataFrame) -> DataFrame:
    cost = cost_columns()
    pct = F.when(F.col("input_tokens") > 0, F.col("cache_read") / F.col("input_tokens") * 100).otherwise(F.lit(0.0))
    return totals(calls).select("input_tokens", "output_tokens", "cache_read", "cache_create", (F.col("input_tokens") - F.col("cache_read") - F.col("cache_create")).alias("fresh_input"), F.round(pct, 6).alias("cache_read_pct"), *(F.round(v, 6).alias(k) for k, v in cost.items()))


def counter(calls: DataFrame, column: str, most: int) -> DataFrame:
    """value, n, pct of the most frequent values; of equals the first seen. No task sees more than its part of them."""
    counts = calls.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    whole = counts.agg(F.sum("n").alias("all"))  # one row
    return counts.join(F.broadcast(whole)).withColumn("pct", F.round(F.col("n") / F.col("all") * 100, 6)).orderBy(F.desc("n"), "first_ord").limit(most).select("value", "n", "pct")


def file_hotspots(calls: DataFrame, most: int = 15) -> DataFrame:
    of = lambda tool: F.count_if(F.col("tool") == tool)
    counts = calls.where(F.col("file").isNotNull() & F.col("tool").isin("Read", "Edit", "Write")).groupBy("file").agg(of("Read").alias("reads"), of("Edit").alias("edits"), of("Write").alias("writes"))
    return counts.withColumn("total", F.col("reads") + F.col("edits") + F.col("writes")).orderBy(F.desc("total"), "file").limit(most)


def hourly(calls: DataFrame, offset_hours: float = 0.0) -> DataFrame:
    """All hours 0 to 23 with their calls and share, in a zone of fixed offset."""
    at = F.hour(F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + int(offset_hours * 3.6e9)))
    counts = calls.groupBy(at.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    every = calls.sparkSession.range(24).select(F.col("id").cast("int").alias("hour")).join(counts, "hour", "left")
    n = F.coalesce("n", F.lit(0))
    return every.select("hour", n.alias("n"), F.round(n / F.sum(n).over(Window.partitionBy()) * 100, 6).alias("pct"))


def daily_cost(calls: DataFrame) -> DataFrame:
    days = calls.groupBy("day").agg(F.count(F.lit(1)).alias("calls"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_create")))
    return days.withColumn("est_cost", cost_columns(fresh_floor=True)["cost_with_cache"])


def forecast(days: DataFrame) -> DataFrame:
    """One row: days, averages, trend of the second half against the first, forecasts from the last seven active days. Days are few: one row each."""
    w = Window.orderBy("day")
    numbered = days.withColumn("i", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    half = F.expr("n div 2")
    one = numbered.agg(
        F.max("n").alias("active_days"), F.greatest(F.lit(1), F.datediff(F.max("day").cast("date"), F.min("day").cast("date")) + 1).alias("total_days"), F.sum("est_cost").alias("total"),
        F.sum(F.when((F.col("i") <= half), F.col("est_cost")).otherwise(0.0)).alias("h1"), F.sum(F.when((F.col("i") > half) & (half > 0), F.col("est_cost")).otherwise(0.0)).alias("h2"),
        F.avg(F.when(F.col("i") > F.col("n") - 7, F.col("est_cost"))).alias("recent"), F.max_by("day", F.struct(F.col("est_cost"), -F.col("i"))).alias("busiest_day"), F.min_by("day", F.struct("est_cost", "i")).alias("quietest_day"),
    )
    trend = F.when(F.col("h1") > 0, (F.col("h2") - F.col("h1")) / F.col("h1") * 100).otherwise(F.lit(0.0))
    ratio = F.col("active_days") / F.col("total_days")
    return one.select(
        F.col("total_days").cast("long").alias("total_days"), "active_days", F.round(F.col("total") / F.col("total_days"), 6).alias("avg_daily_cost"), F.round(F.col("total") / F.col("active_days"), 6).alias("avg_active_day_cost"),
        F.when(trend > 20, "increasing").when(trend < -20, "decreasing").otherwise("stable").alias("trend"), F.round(trend, 4).alias("trend_pct"),
        F.round(F.col("recent") * 7 * ratio, 6).alias("forecast_7d"), F.round(F.col("recent") * 30 * ratio, 6).alias("forecast_30d"), "busiest_day", "quietest_day",
    )


def context_pressure(calls: DataFrame, least_calls: int = 5) -> DataFrame:
    """Of sessions of at least five calls: largest input and where it first came, growth of the last five over the first five, and whether
    the last fifth is below 0.7 of the middle third (slices as floor and ceiling divisions put them)."""
    w = Window.partitionBy("session_id")
    numbered = calls.withColumn("inp", F.coalesce("input_tokens", F.lit(0)).cast("long")).withColumn("i", F.row_number().over(w.orderBy("ord"))).withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") >= least_calls)
    third, two_thirds, fifth = F.expr("n div 3"), F.expr("2 * n div 3"), F.expr("n div 5")
    late = F.expr("-((-n) div 5) + if((-n) % 5 <> 0, 1, 0)")  # ceiling
    total = lambda cond: F.sum(F.when(cond, F.col("inp")).otherwise(0))
    i = F.col("i")
    sums = numbered.groupBy("session_id").agg(
        F.max("n").alias("total_calls"), F.max("inp").alias("max_input"), F.sum("inp").alias("cumulative_input"), F.when(F.max("inp") > 0, F.min_by("i", F.struct(-F.col("inp"), i))).otherwise(0).alias("peak_call"),
        total(i <= 5).alias("first5"), total(i > F.col("n") - 5).alias("last5"), total((i > third) & (i <= two_thirds)).alias("mid"), total(i > F.col("n") - late).alias("late"),
        F.max(third).alias("third"), F.max(fifth).alias("fifth"),
    )
    growth = F.when((F.col("total_calls") >= 10) & (F.col("first5") > 0), (F.col("last5") / 5 - F.col("first5") / 5) / (F.col("first5") / 5)).otherwise(F.lit(0.0))
    mid, end = F.col("mid") / F.greatest(F.lit(1), "third"), F.col("late") / F.greatest(F.lit(1), "fifth")
    return sums.select("session_id", "total_calls", "max_input", "cumulative_input", "peak_call", F.round(growth, 6).alias("input_growth"), ((F.col("total_calls") >= 20) & (mid > 0) & (end < mid * 0.7)).alias("likely_compressed"))


def pressure_rollup(pressure: DataFrame) -> DataFrame:
    return pressure.agg(F.count(F.lit(1)).alias("sessions"), F.count_if("likely_compressed").alias("compressed"), F.round(F.count_if("likely_compressed") / F.count(F.lit(1)), 6).alias("rate"), F.round(F.avg("cumulative_input"), 6).alias("avg_cumulative"), F.max("cumulative_input").alias("max_cumulative"))


def beside(calls: DataFrame, turns: DataFrame) -> DataFrame:
    """Calls and user turns (session_id, ts, prompt) of sessions as one stream: is_call tells them apart, a turn has no tokens and no tool, a call no prompt."""
    said = turns.select("session_id", "ts", F.col("prompt").cast("string").alias("prompt"), F.lit(False).alias("is_call"))
    return calls.drop("prompt").withColumn("is_call", F.lit(True)).unionByName(said, allowMissingColumns=True)


def efficiency(calls: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """Of each session with calls: output over input, tool success (failures are not logged: 1.0), files edited, edits a file, churned files.

    With turns, hours span these too, and corrections counts the turns that correct, correction_rate their share of all that say something; null text says nothing."""
    edits = calls.where((F.col("tool") == "Edit") & F.col("file").isNotNull()).groupBy("session_id", "file").agg(F.count(F.lit(1)).alias("n"))
    per = edits.groupBy("session_id").agg(F.count(F.lit(1)).alias("files_edited"), F.avg("n").alias("avg_edits"), F.count_if(F.col("n") >= 5).alias("churn_files"))
    stream = calls.withColumn("is_call", F.lit(True)) if turns is None else beside(calls, turns)
    said = [] if turns is None else [F.count_if(F.trim("prompt") != "").alias("turns"), F.count_if(F.col("prompt").rlike(CORRECTION)).alias("corrections")]
    sums = stream.groupBy("session_id").agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.count_if("is_call").alias("calls"), *said).where("calls > 0")
    rate = [] if turns is None else ["corrections", F.round(F.when(F.col("turns") > 0, F.col("corrections") / F.col("turns")).otherwise(F.lit(0.0)), 6).alias("correction_rate")]
    return sums.join(per, "session_id", "left").select("session_id", F.round(F.when(F.col("i") > 0, F.col("o") / F.col("i")).otherwise(F.lit(0.0)), 9).alias("token_ratio"), F.lit(1.0).alias("tool_success"), F.coalesce("files_edited", F.lit(0)).alias("files_edited"), F.round(F.coalesce("avg_edits", F.lit(0.0)), 6).alias("avg_edits_per_file"), F.coalesce("churn_files", F.lit(0)).alias("churn_files"), F.round(hours(F.col("a"), F.col("b")), 6).alias("duration_hours"), *rate)


def file_churn(calls: DataFrame, least: int = 5, most: int = 15) -> DataFrame:
    per = calls.where(F.col("file").isNotNull() & F.col("tool").isin("Edit", "Read")).groupBy("file", "session_id").agg(F.count_if(F.col("tool") == "Edit").alias("e"), F.count_if(F.col("tool") == "Read").alias("r"))
    out = per.groupBy("file").agg(F.sum("e").alias("total_edits"), F.count_if(F.col("e") > 0).alias("sessions"), F.max("e").alias("max_edits"), F.sum("r").alias("total_reads")).where(F.col("total_edits") >= least)
    return out.select("file", "total_edits", "sessions", F.round(F.col("total_edits") / F.col("sessions"), 6).alias("avg_edits"), "max_edits", "total_reads", F.round(F.col("total_reads") / F.col("total_edits"), 6).alias("read_edit_ratio")).orderBy(F.desc("total_edits"), "file").limit(most)


def frequent_files(calls: DataFrame, least_reads: int = 10, least_sessions: int = 3, most: int = 10) -> DataFrame:
    out = calls.where((F.col("tool") == "Read") & F.col("file").isNotNull()).groupBy("file").agg(F.count(F.lit(1)).alias("reads"), F.countDistinct("session_id").alias("sessions"))
    return out.where((F.col("reads") >= least_reads) & (F.col("sessions") >= least_sessions)).orderBy(F.desc("reads"), "file").limit(most)


def prompt_stats(prompts: DataFrame) -> DataFrame:
    """Lengths, their upper median, and counts of questions, commands and corrections. The median is found from the counts of each length."""
    n = F.length("prompt")
    by_length = prompts.groupBy(n.alias("n")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.contains("prompt", F.lit("?"))).alias("q"), F.count_if(F.trim("prompt").rlike(COMMAND)).alias("cmd"), F.count_if(F.col("prompt").rlike(CORRECTION)).alias("cor"))
    below = by_length.select("*", F.sum("c").over(Window.orderBy("n")).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("all"))
    bucket = lambda cond: F.sum(F.when(cond, F.col("c")).otherwise(0))
    one = below.agg(F.sum("c").alias("prompts"), F.round(F.sum(F.col("n") * F.col("c")) / F.sum("c"), 6).alias("avg_length"), F.min(F.when(F.col("upto") > F.expr("all div 2"), F.col("n"))).alias("median_length"), bucket(F.col("n") < 50).alias("short"), bucket((F.col("n") >= 50) & (F.col("n") < 200)).alias("medium"), bucket(F.col("n") >= 200).alias("long"), F.sum("q").alias("questions"), F.sum("cmd").alias("commands"), F.sum("cor").alias("corrections"))
    return one.withColumn("correction_ratio", F.round(F.when(F.col("prompts") > 0, F.col("corrections") / F.col("prompts")).otherwise(F.lit(0.0)), 6))


def length_buckets(sessions: DataFrame) -> DataFrame:
    """Sessions by their length: number and means, of corrections too where sessions have them."""
    label, order = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (name, low, high) in enumerate(LENGTHS):
        inside = (F.col("duration_hours") >= low) & (F.col("duration_hours") < high)
        label, order = F.when(inside, F.lit(name)).otherwise(label), F.when(inside, F.lit(i)).otherwise(order)
    means = (("token_ratio", 9), ("tool_success", 6), ("avg_edits_per_file", 6)) + ((("corrections", 6),) if "corrections" in sessions.columns else ())
    return sessions.withColumn("label", label).withColumn("bucket", order).where(F.col("label").isNotNull()).groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("sessions"), *(F.round(F.avg(c), places).alias("avg_" + c.removeprefix("avg_")) for c, places in means))


def optimal_length(buckets: DataFrame) -> DataFrame:
    """The bucket of at least two sessions with the highest ratio * 1000 + success - corrections / 10 above 0; of equals the shortest; else the first bucket."""
    value = F.col("avg_token_ratio") * 1000 + F.col("avg_tool_success") - (F.col("avg_corrections") * 0.1 if "avg_corrections" in buckets.columns else F.lit(0.0))
    good = F.max_by("label", F.when((F.col("sessions") >= 2) & (value > 0), F.struct(value, -F.col("bucket"))))
    return buckets.agg(F.coalesce(good, F.min_by("label", "bucket"), F.lit("Not enough data")).alias("optimal_length"))


# What is advised, with the limits beyond which it is.
LOW_RATIO, MANY_EDITS, WORST_EDITS, MANY_CORRECTIONS, SHORT_PROMPT = 0.002, 4, 20, 0.1, 30


def workflow_advice(sessions: DataFrame, churn: DataFrame, said: DataFrame, optimal: DataFrame) -> DataFrame:
    """advice, subject, value: each rule that holds of efficiency() with turns, file_churn(), prompt_stats() and optimal_length(). The last is always given.

    subject is the file most edited, or the length advised; value is the figure that the rule looked at. All inputs but sessions are a few rows."""
    means = sessions.agg(F.avg("token_ratio").alias("ratio"), F.avg("avg_edits_per_file").alias("edits"))
    worst = churn.agg(F.min_by(F.struct("file", "total_edits"), F.struct(-F.col("total_edits"), F.col("file"))).alias("worst"))
    parts = means.unionByName(worst, True).unionByName(said.select(F.col("correction_ratio").alias("corrected"), F.col("avg_length").alias("length")), True).unionByName(optimal, True)
    one = parts.agg(*(F.max(c).alias(c) for c in parts.columns))  # each part is one row with nulls for what the others hold
    rule = lambda name, cond, subject, value: F.when(cond, F.struct(F.lit(name).alias("advice"), subject.cast("string").alias("subject"), F.round(value.cast("double"), 6).alias("value")))
    none = F.lit(None)
    found = F.array(
        rule("low_token_efficiency", F.col("ratio") < LOW_RATIO, none, F.col("ratio")), rule("many_edits_per_file", F.col("edits") > MANY_EDITS, none, F.col("edits")),
        rule("split_file", F.col("worst.total_edits") > WORST_EDITS, F.col("worst.file"), F.col("worst.total_edits")), rule("many_corrections", F.col("corrected") > MANY_CORRECTIONS, none, F.col("corrected")),
        rule("short_prompts", F.col("length") < SHORT_PROMPT, none, F.col("length")), rule("session_length", F.lit(True), F.col("optimal_length"), none),
    )
    return one.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("x.*")


def project_rollup(calls: DataFrame) -> DataFrame:
    """Usage by project (a column of calls) with a total row."""
    out = calls.rollup("project").agg(F.countDistinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("ai_calls"), *(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_create")), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return out.select(F.coalesce("project", F.lit("total")).alias("project"), "sessions", "ai_calls", "input_tokens", "output_tokens", "first_day", "last_day", F.round(cost_columns()["cost_with_cache"], 6).alias("est_cost"))


def turn_pairing(turns: DataFrame) -> DataFrame:
    """Each assistant turn with the latest user turn before it that no other assistant turn took; null if none is pending."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    grouped = turns.where(F.col("role").isin("user", "assistant")).withColumn("g", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_group = Window.partitionBy("conv_id", "g").orderBy("turn")
    nth = F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(in_group.rowsBetween(Window.unboundedPreceding, 0))
    user = F.first(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(in_group.rowsBetween(Window.unboundedPreceding, 0))
    return grouped.withColumn("nth", nth).withColumn("u", user).where("role = 'assistant'").select("conv_id", "turn", F.when(F.col("nth") == 1, F.col("u")).alias("user_turn"))


def document_effect(calls: DataFrame, document: str, least_calls: int = 3, turns: DataFrame | None = None) -> DataFrame:
    """Sessions of at least three calls, split by whether they read the document: number, mean output over input, mean edits a file; with turns, the mean share of turns that doubt."""
    stream = calls.withColumn("is_call", F.lit(True)) if turns is None else beside(calls, turns)
    said = [] if turns is None else [F.count_if(~F.col("is_call")).alias("turns"), F.count_if(F.col("prompt").rlike(DOUBT)).alias("doubts")]
    per = stream.groupBy("session_id").agg(
        F.count_if("is_call").alias("n"), F.bool_or(F.coalesce((F.col("tool") == "Read") & (F.col("file") == document), F.lit(False))).alias("reads_it"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"),
        F.count_if(F.col("tool") == "Edit").alias("edits"), F.countDistinct(F.when(F.col("tool") == "Edit", F.col("file"))).alias("files"), *said,
    ).where(F.col("n") >= least_calls)
    ratio = F.when(F.col("i") > 0, F.col("o") / F.col("i")).otherwise(F.lit(0.0))
    edits = F.when(F.col("files") > 0, F.col("edits") / F.col("files")).otherwise(F.lit(0.0))
    rate = [] if turns is None else [F.round(F.avg(F.when(F.col("turns") > 0, F.col("doubts") / F.col("turns")).otherwise(F.lit(0.0))), 6).alias("correction_rate")]
    return per.groupBy("reads_it").agg(F.count(F.lit(1)).alias("sessions"), F.round(F.avg(ratio), 9).alias("token_ratio"), F.round(F.avg(edits), 6).alias("edits_per_file"), *rate)


def document_insight(effect: DataFrame) -> DataFrame:
    """metric, with_reads, without_reads, delta_pct of document_effect() with turns: those metrics whose mean without the document is above 0; no row unless there are sessions of both kinds."""
    of = lambda c, reads: F.max(F.when(F.col("reads_it") == reads, F.col(c)))
    metrics = ("correction_rate", "token_ratio", "edits_per_file")
    one = effect.agg(*(of(c, r).alias(f"{c}_{int(r)}") for c in metrics for r in (True, False)))
    rows = one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"{c}_1").alias("with_reads"), F.col(f"{c}_0").alias("without_reads")) for c in metrics))))
    return rows.where("with_reads IS NOT NULL AND without_reads > 0").withColumn("delta_pct", F.round((F.col("with_reads") - F.col("without_reads")) / F.col("without_reads") * 100, 4))


def workflow_patterns(calls: DataFrame) -> DataFrame:
    """pattern, value: style, cache use, intensity, most edited file, peak hour, night share, preferred tool, reads over edits; only those whose rule holds."""
    hour = F.hour("ts")
    by_hour = calls.groupBy(hour.alias("h")).agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("h", F.struct(-F.col("n"), F.col("h"))).alias("peak"), (F.sum(F.when(F.col("h") < 6, F.col("n")).otherwise(0)) / F.sum("n") * 100).alias("night"))
    by_session = calls.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("heaviest"), F.count(F.lit(1)).alias("sessions"))
    by_file = calls.where(F.col("file").isNotNull()).groupBy("file").agg(F.count_if(F.col("tool") == "Edit").alias("edits")).agg(F.max("edits").alias("edits"), F.min_by("file", F.struct(-F.col("edits"), F.col("file"))).alias("edited"))
    by_tool = counter(calls, "tool", 1).select(F.col("value").alias("tool"))
    sums = calls.agg(F.count(F.lit(1)).alias("calls"), F.count("tool").alias("tools"), F.sum("input_tokens").alias("i"), F.sum("cache_read").alias("r"), F.count_if(F.col("tool") == "Read").alias("reads"), F.count_if(F.col("tool") == "Edit").alias("edit_calls"))
    # Each of the five is one row; laid under each other and folded, they are one.
    parts = by_hour.unionByName(by_session, True).unionByName(by_file, True).unionByName(by_tool, True).unionByName(sums, True)
    one = parts.agg(*(F.max(c).alias(c) for c in parts.columns))
    share, cache, ratio = F.col("tools") / F.col("calls") * 100, F.col("r") / F.col("i") * 100, F.try_divide("reads", "edit_calls")
    is_ = lambda name, cond, value: F.when(cond, F.struct(F.lit(name).alias("pattern"), value.cast("string").alias("value")))
    two = lambda c: F.format_string("%.1f", c)
    found = F.array(
        is_("style", F.lit(True), F.when(share > 60, "builder").when(share > 40, "hybrid").otherwise("advisor")), is_("cache", cache > 50, F.when(cache > 90, "high").otherwise("moderate")),
        is_("intensity", F.col("sessions") > 0, F.col("heaviest")), is_("iteration", F.col("edits") > 20, F.col("edited")), is_("peak_hour", F.lit(True), F.col("peak")), is_("night", F.col("night") > 20, two(F.col("night"))),
        is_("tool", F.col("tool").isNotNull(), F.col("tool")), is_("read_heavy", ratio > 1.5, two(ratio)), is_("edit_heavy", ratio < 0.5, two(ratio)),
    )
    return one.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("x.*")


def delegation_calls(calls: DataFrame) -> DataFrame:
    """Calls of agents by type: how many, in how many sessions."""
    return calls.where(F.col("tool") == "Agent").groupBy(F.coalesce("agent_type", F.lit("general-purpose")).alias("agent_type")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("sessions"), F.round(F.avg(F.length("prompt")), 6).alias("avg_prompt"), F.max(F.length("prompt")).alias("max_prompt"))


def inboxes(messages: DataFrame) -> DataFrame:
    """Of each inbox: messages, senders, the most frequent sender (of equals the first), first and last time in order."""
    sent = messages.groupBy("inbox", "sender").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"), F.min_by("ts", "ord").alias("a"), F.max_by("ts", "ord").alias("b"), F.max("ord").alias("last_ord"))
    return sent.groupBy("inbox").agg(F.sum("n").alias("messages"), F.count(F.lit(1)).alias("senders"), F.min_by("sender", F.struct(-F.col("n"), F.col("first_ord"))).alias("top_sender"), F.min_by("a", "first_ord").alias("first_time"), F.max_by("b", "last_ord").alias("last_time"))


def first_day(last: str | None = None, since: str | None = None, now: dt.datetime | None = None) -> dt.date | None:
    """The day from which sessions count: `last` as 7d, 2w or 3m (months of 30 days) before now, else the day `since`; None without one or for an unreadable day."""
    if last:
        last = last.lower().strip()
        days = {"d": 1, "w": 7, "m": 30}.get(last[-1:])
        return None if days is None else ((now or dt.datetime.now(dt.UTC)) - dt.timedelta(days=days * int(last[:-1]))).date()
    try:
        return dt.datetime.strptime(since, "%Y-%m-%d").date() if since else None
    except ValueError:
        return None


def within(sessions: DataFrame, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
    """Sessions whose first day is since or later and before until; those of the unknown day `?` stay."""
    kept = F.lit(True)
    if since:
        kept = kept & (F.col("day") >= F.lit(since.isoformat()))
    if until:
        kept = kept & (F.col("day") < F.lit(until.isoformat()))
    return sessions.where(kept | (F.col("day") == "?"))
