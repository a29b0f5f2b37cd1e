"""Field coverage of spans and what is scored on it: requirements, tiers, gaps.

All (field, check) pairs that the rules name are measured in one aggregate over the spans, whatever their number; the result is a
row for each pair, and everything after it is small.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SATISFIED, PARTIAL = 0.95, 0.25
SAMPLES, SAMPLE_CHARS = 5, 80


def field_column(spans: DataFrame, field: str) -> Column | None:
    """The column that a field path names; None if spans have none, which counts as null everywhere. `finish_reasons` may come as one reason."""
    name = field.removeprefix("spans[].")
    if name == "trace_id":  # an attribute of the trace, not of its spans
        return None
    if name in spans.columns:
        return F.col(name)
    return F.col("finish_reason") if name == "finish_reasons" and "finish_reason" in spans.columns else None


def is_present(column: Column | None, kind: T.DataType | None, check: str) -> Column:
    """`present` holds always; `non_empty` asks strings, arrays and maps for a length; any other check, retention too, asks for a value."""
    if check == "present":
        return F.lit(True)
    if column is None:
        return F.lit(False)
    if check == "non_empty" and isinstance(kind, T.StringType):
        return F.coalesce(F.length(column) > 0, F.lit(False))
    if check == "non_empty" and isinstance(kind, T.ArrayType | T.MapType):
        return F.coalesce(F.size(column) > 0, F.lit(False))
    return column.isNotNull()


def coverage(spans: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """field, check_type, population, present_count, coverage for each of the distinct pairs, from one pass over spans."""
    pairs = sorted(set(pairs))
    kinds = {f.name: f.dataType for f in spans.schema.fields}
    counts = []
    for i, (field, check) in enumerate(pairs):
        column = field_column(spans, field)
        kind = None if column is None else kinds.get("finish_reason" if field == "finish_reasons" and field not in kinds else field)
        counts.append(F.count_if(is_present(column, kind, check)).alias(f"c{i}"))
    one = spans.agg(F.count(F.lit(1)).alias("population"), *counts)
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(c).alias("check_type"), F.col(f"c{i}").alias("present_count")) for i, (f, c) in enumerate(pairs))))
    out = one.select("population", rows.alias("r")).select("r.field", "r.check_type", "population", "r.present_count")
    return out.withColumn("coverage", F.when(F.col("population") > 0, F.col("present_count") / F.col("population")).otherwise(F.lit(0.0)))


def samples(spans: DataFrame, field: str, most: int = SAMPLES) -> DataFrame:
    """sample_ord, sample: the first distinct values of a field in the order of trace and span, cut to 80 characters."""
    column = field_column(spans, field)
    if column is None:
        return spans.limit(0).select(F.lit(0).alias("sample_ord"), F.lit("").alias("sample"))
    text = column.cast("string")
    short = F.when(F.length(text) > SAMPLE_CHARS, F.concat(F.substring(text, 1, SAMPLE_CHARS), F.lit("..."))).otherwise(text)
    first = spans.where(column.isNotNull()).groupBy(short.alias("sample")).agg(F.min(F.struct("trace_id", "span_ord")).alias("at"))
    top = first.orderBy("at").limit(most)  # five rows, so numbering them in one task is no matter
    return top.select(F.row_number().over(Window.orderBy("at")).alias("sample_ord"), "sample")


def sample_text(column: Column, kind: T.DataType) -> Column:
    """A value as a short text: text beyond 80 characters is cut, of a list its first three, of a map or struct beyond 80 characters its first three keys."""
    if isinstance(kind, T.ArrayType):
        return F.to_json(F.slice(column, 1, 3))
    if isinstance(kind, T.MapType | T.StructType):
        whole = F.to_json(column)
        keys = F.slice(F.map_keys(column), 1, 3) if isinstance(kind, T.MapType) else F.array(*(F.lit(n) for n in kind.names[:3]))
        return F.when(F.length(whole) > SAMPLE_CHARS, F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda _: F.lit("..."))))).otherwise(whole)
    text = column.cast("string")
    return F.when(F.length(text) > SAMPLE_CHARS, F.concat(F.substring(text, 1, SAMPLE_CHARS), F.lit("..."))).otherwise(text)


def first_samples(rows: DataFrame, paths: list[tuple[str, Column | None, T.DataType | None, Column]], order: list[str], most: int = SAMPLES, distinct: bool = False) -> DataFrame:
    """field, samples: of each path (name, column, type, whether present) the first values that are present and not null, at most five, by the columns of order; rows of the same place by their text.

    distinct: of equal samples only the first counts. All paths are taken in one pass: a task keeps five rows for each path, and only these are shuffled, so
    nothing is sorted but what is kept. A path that names nothing, or has no value, has an empty list."""
    names = [p for p, column, *_ in paths if column is not None]
    taken = [F.when(present, sample_text(column, kind)).alias(f"s{i}") for i, (_, column, kind, present) in enumerate(x for x in paths if x[1] is not None)]
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) if rows.schema[c].dataType == T.StringType() else F.coalesce(F.unix_micros(F.col(c).cast("timestamp")) if isinstance(rows.schema[c].dataType, T.TimestampType | T.TimestampNTZType) else F.col(c).cast("long"), F.lit(0)) for c in order]
    placed = rows.select(*(k.alias(f"k{i}") for i, k in enumerate(keys)), *taken)

    width = len(keys)

    def run(batches):
        kept = [{} for _ in names]  # sample -> key where distinct, else key and sample -> key
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(width)]
            places = list(zip(*columns, strict=True))
            for n, held in enumerate(kept):
                worst = max(held.values()) if len(held) == most else None
                for place, sample in zip(places, batch.column(width + n).to_pylist(), strict=True):
                    if sample is None or (worst is not None and (place, sample) >= worst):
                        continue
                    at, name = (place, sample), sample if distinct else (place, sample, len(held))
                    if name in held:
                        held[name] = min(held[name], at)
                    else:
                        if len(held) == most:
                            del held[max(held, key=held.get)]
                        while not distinct and name in held:  # repeated rows are rows of their own
                            name = (*name[:2], name[2] + 1)
                        held[name] = at
                    worst = max(held.values()) if len(held) == most else None
        out = [(names[n], *place, sample) for n, held in enumerate(kept) for place, sample in held.values()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out, strict=True)], names=["field", *(f"k{i}" for i in range(width)), "sample"])

    kinds = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(placed.schema.fields[: width]))
    key = F.struct(*(F.col(f"k{i}") for i in range(width)), F.col("sample"))
    firsts = placed.mapInArrow(run, f"field string, {kinds}, sample string").select("field", key.alias("at"))
    if distinct:
        firsts = firsts.groupBy("field", "at.sample").agg(F.min("at").alias("at"))
    best = firsts.withColumn("__n", F.row_number().over(Window.partitionBy("field").orderBy("at"))).where(F.col("__n") <= most)
    lists = best.groupBy("field").agg(F.array_sort(F.collect_list("at")).alias("best")).select("field", F.transform("best", lambda x: x["sample"]).alias("samples"))  # at most five each
    every = rows.sparkSession.createDataFrame([(p,) for p in sorted({p for p, *_ in paths})], "field string")
    return every.join(lists, "field", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


def coverage_samples(spans: DataFrame, fields: list[str], order: tuple[str, str] = ("trace_id", "span_ord")) -> DataFrame:
    """field, samples of span fields: the first five distinct values of each, by trace and span."""
    named = [(f, field_column(spans, f)) for f in sorted(set(fields))]
    kinds = {f.name: f.dataType for f in spans.select(*(c.alias(f) for f, c in named if c is not None)).schema.fields}
    return first_samples(spans, [(f, c, kinds.get(f), F.lit(True) if c is None else c.isNotNull()) for f, c in named], list(order), distinct=True)


def path_samples(rows: DataFrame, pairs: list[tuple[str, str]], order: list[str]) -> DataFrame:
    """path_coverage() with samples: the first five values of each path by the columns of order, repeats and all; the check says which values are present."""
    named = [(p, c, nested_column(rows, p)) for p, c in sorted(set(pairs))]
    kinds = {f.name: f.dataType for f in rows.select(*(col.alias(f"c{i}") for i, (_, _, col) in enumerate(named) if col is not None)).schema.fields}
    each = [(f"{p}\x1f{c}", col, kinds.get(f"c{i}"), is_present(col, kinds.get(f"c{i}"), c)) for i, (p, c, col) in enumerate(named)]
    found = first_samples(rows, each, order).select(F.split_part("field", F.lit("\x1f"), F.lit(1)).alias("field"), F.split_part("field", F.lit("\x1f"), F.lit(2)).alias("check_type"), "samples")
    return path_coverage(rows, pairs).join(found, ["field", "check_type"])


# What to do about a field that is not logged.
ADVICE = {
    "start_time": "Ensure your trace exporter includes span timestamps. OTel exporters do this by default; check your export configuration.",
    "end_time": "Ensure span end timestamps are recorded. This requires proper span.end() calls in your instrumentation.",
    "model_used": "Log the actual model version returned in the API response, not just the requested model. OTel: set gen_ai.response.model. Langfuse: set internalModel.",
    "model_requested": "Log the model name specified in the API request. OTel: set gen_ai.request.model.",
    "input_tokens": "Enable token usage logging. Most LLM APIs return token counts in the response. OTel: set gen_ai.usage.input_tokens.",
    "output_tokens": "Enable token usage logging. OTel: set gen_ai.usage.output_tokens.",
    "error_type": "Log error types when API calls fail. OTel: set error.type on the span and mark span status as ERROR.",
    "finish_reasons": "Log the finish/stop reason from the API response. OTel: set gen_ai.response.finish_reasons.",
    "input_messages": "Enable content logging (opt-in for privacy). OTel: emit gen_ai.client.inference.operation.details events with gen_ai.input.messages. Note: this may contain sensitive data.",
    "output_messages": "Enable content logging (opt-in for privacy). OTel: emit gen_ai.client.inference.operation.details events with gen_ai.output.messages.",
    "tool_calls": "Log tool/function calls made by the model. OTel: use gen_ai.tool.name, gen_ai.tool.call.id attributes.",
    "provider": "Include the AI provider name in your traces. OTel: set gen_ai.provider.name (e.g., 'openai', 'anthropic').",
}


def gap_advice(all_gaps: DataFrame) -> DataFrame:
    """rule_id, field_path, impact, recommendation of gaps(): why a gap matters, cited by regulation and rule, and what to do about its field; of fields without a text of their own, to add them."""
    counts = F.concat(F.col("present_count").cast("string"), F.lit("/"), F.col("population").cast("string"))
    path = F.concat(F.lit("`"), "field_path", F.lit("`"))
    zero = F.concat(F.lit("your traces contain zero values for "), path, F.lit("."))
    some = F.concat(F.lit("only "), counts, F.lit(" spans have "), path, F.lit("."))
    known = F.create_map(*(F.lit(x) for pair in ADVICE.items() for x in pair))
    other = F.concat(F.lit("Add "), path, F.lit(" to your trace exports. Currently "), counts, F.lit(" spans include this field."))
    impact = F.concat("regulation", F.lit(" "), "rule_id", F.lit(" — "), F.when(F.col("present_count") == 0, zero).otherwise(some))
    return all_gaps.select("rule_id", "field_path", impact.alias("impact"), F.coalesce(F.try_element_at(known, F.element_at(F.split("field_path", r"\."), -1)), other).alias("recommendation"))


def scored(rules: DataFrame, fields: DataFrame, covered: DataFrame) -> DataFrame:
    """rules with score and status: the weighted mean coverage of their fields; 1.0 without fields."""
    each = fields.join(covered, ["field", "check_type"], "left")
    sums = each.groupBy("rule_id").agg((F.sum(F.coalesce("coverage", F.lit(0.0)) * F.col("weight")) / F.sum("weight")).alias("score"))
    out = rules.join(sums, "rule_id", "left").withColumn("score", F.coalesce("score", F.lit(1.0)))
    return out.withColumn("status", status(F.col("score")))


def status(score: Column) -> Column:
    return F.when(score >= SATISFIED, "satisfied").when(score >= PARTIAL, "partial").otherwise("missing")


def gaps(rules: DataFrame, fields: DataFrame, covered: DataFrame) -> DataFrame:
    """A row for each field of a rule whose coverage is below 0.95, with a description and the coverage in per cent, rounded half to even."""
    each = fields.join(rules.select("rule_id", "regulation"), "rule_id").join(covered, ["field", "check_type"]).where(F.col("coverage") < SATISFIED)
    said = F.regexp_replace("field", "_", " ")
    pct = F.bround(F.col("coverage") * 100, 1)
    text = F.when(F.col("present_count") == 0, F.concat(F.lit("Not logging: "), said)).otherwise(F.concat(F.lit("Incomplete: "), said))
    return each.select("rule_id", "regulation", "field_ord", F.concat(F.lit("spans[]."), "field").alias("field_path"), text.alias("description"), pct.alias("coverage_pct"), "present_count", "population")


def report(rules_scored: DataFrame, all_gaps: DataFrame) -> DataFrame:
    """regulation, overall_score, n_satisfied, n_partial, n_missing, requirements: a nested row for each regulation, to be written as JSON.

    requirements are structs of rule, severity, score, status and gaps, by rule; gaps are in the order of the rule's fields, with impact and recommendation.
    Its size is that of the catalogue of rules, however many spans were measured. Equal rule ids are one rule."""
    told = all_gaps.join(gap_advice(all_gaps), ["rule_id", "field_path"])
    gap = F.struct("field_ord", "field_path", "description", "coverage_pct", "impact", "recommendation")
    of_rule = told.groupBy("rule_id").agg(F.array_sort(F.collect_set(gap)).alias("gaps"))
    each = rules_scored.join(of_rule, "rule_id", "left").withColumn("gaps", F.coalesce("gaps", F.array().cast(of_rule.schema["gaps"].dataType)))
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return each.groupBy("regulation").agg(F.avg("score").alias("overall_score"), n("satisfied"), n("partial"), n("missing"), F.array_sort(F.collect_set(F.struct("rule_id", "severity", "score", "status", "gaps"))).alias("requirements"))


def top_gaps(rules_scored: DataFrame, all_gaps: DataFrame, most: int = 5) -> DataFrame:
    """The gaps of the lowest-scored rules, by score and then description, both from the far end."""
    ranked = all_gaps.join(rules_scored.select("rule_id", "score"), "rule_id")
    return ranked.orderBy(F.col("score").asc(), F.col("description").desc(), "rule_id", "field_ord").limit(most).select("rule_id", "field_path", "description", "score")


def tiers(rules_scored: DataFrame) -> DataFrame:
    """Mean score and counts of each tier that has rules; rules without a tier belong to none."""
    return rules_scored.where(F.col("tier").isNotNull()).groupBy("tier").agg(F.avg("score").alias("tier_score"), F.count(F.lit(1)).alias("n_rules"), F.count_if(F.col("status") == "satisfied").alias("n_satisfied"), F.count_if(F.col("status") != "satisfied").alias("n_gaps"))


def summary(rules_scored: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return rules_scored.agg(F.count(F.lit(1)).alias("n_rules"), n("satisfied"), n("partial"), n("missing"), F.avg("score").alias("overall_score"))


def trace_totals(spans: DataFrame) -> DataFrame:
    """Of each trace: spans, agents, whether several, tokens, models and time bounds."""
    return spans.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n_spans"), F.countDistinct(F.nullif(F.col("agent_id"), F.lit(""))).alias("n_agents"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce("model_used", "model_requested", F.lit("unknown")))), ",").alias("models"),
        F.min("start_time").alias("first_time"), F.max("start_time").alias("last_time"),
    ).withColumn("is_multi_agent", F.col("n_agents") > 1)


def nested_column(rows: DataFrame, path: str) -> Column | None:
    """What a dotted path names: the first part is a column, and what follows is in its struct or map, or in its JSON text."""
    first, *rest = path.split(".")
    if first not in rows.columns:
        return None
    column, kind = F.col(first), rows.schema[first].dataType
    while rest:
        if isinstance(kind, T.StringType):
            return F.get_json_object(column, "$." + ".".join(rest))
        part = rest.pop(0)
        if isinstance(kind, T.StructType):
            if part not in kind.names:
                return None
            column, kind = column.getField(part), kind[part].dataType
        elif isinstance(kind, T.MapType):
            column, kind = F.try_element_at(column, F.lit(part)), kind.valueType
        else:
            return None
    return column


def path_coverage(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """As coverage, for paths into spans (`a.b.c`) or, over a table of traces, for their own fields and `metadata.f`. A path that names nothing has no population."""
    named = [(p, c, nested_column(rows, p)) for p, c in sorted(set(pairs))]
    kinds = {f.name: f.dataType for f in rows.select(*(col.alias(f"c{i}") for i, (_, _, col) in enumerate(named) if col is not None)).schema.fields}
    counts = [F.count_if(is_present(col, kinds.get(f"c{i}"), c)).alias(f"c{i}") for i, (_, c, col) in enumerate(named)]
    one = rows.agg(F.count(F.lit(1)).alias("n"), *counts)
    each = [F.struct(F.lit(p).alias("field"), F.lit(c).alias("check_type"), (F.lit(0).cast("long") if col is None else F.col("n")).alias("population"), (F.lit(0).cast("long") if col is None else F.col(f"c{i}")).alias("present_count")) for i, (p, c, col) in enumerate(named)]
    out = one.select(F.explode(F.array(*each)).alias("r")).select("r.*")
    return out.withColumn("coverage", F.when(F.col("population") > 0, F.col("present_count") / F.col("population")).otherwise(F.lit(0.0)))
