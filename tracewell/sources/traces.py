"""Spans from four formats of JSON: OTLP exports, observation exports, API logs and conversation logs.

Each normalizer takes entries (file, ord, entry) with one JSON value a row and returns spans with the same columns. Values are read
with explicit schemas; what a row lacks is null. Entries of a file keep their order in ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files

COLUMNS = (
    "trace_id", "span_ord", "source_format", "session_id", "span_id", "parent_span_id", "operation", "provider", "model_requested", "model_used", "start_time", "end_time", "duration_ms",
    "input_tokens", "output_tokens", "total_tokens", "finish_reasons", "error_type", "error_message", "agent_id", "agent_name", "agent_framework", "span_kind", "tool_name", "mcp_server_uri", "input_messages", "output_messages",
    "response_id", "temperature", "max_tokens", "input_cost", "output_cost", "total_cost", "messages_in", "messages_out", "tool_calls", "evaluations", "metadata",
)
# What a span holds of nested content. input_messages and output_messages are the texts as they stand; messages_in and messages_out are read from them.
_MESSAGES = "array<struct<role: string, content: string>>"
_NESTED = {
    "messages_in": _MESSAGES, "messages_out": _MESSAGES, "tool_calls": "array<struct<id: string, name: string, type: string, arguments: string>>",
    "evaluations": "array<struct<name: string, score_value: double, score_label: string, explanation: string>>", "metadata": "map<string, string>",
}
_VALUE = "stringValue string, intValue string, doubleValue string, boolValue string"
_ATTRIBUTES = f"array<struct<key: string, value: struct<{_VALUE.replace(' string', ': string')}, arrayValue: struct<values: array<struct<{_VALUE.replace(' string', ': string')}>>>>>>"
_SPAN = f"struct<traceId: string, trace_id: string, spanId: string, span_id: string, parentSpanId: string, parent_span_id: string, name: string, startTimeUnixNano: string, endTimeUnixNano: string, status: struct<code: string, statusCode: string, message: string>, attributes: {_ATTRIBUTES}, events: array<struct<attributes: {_ATTRIBUTES}>>>"
OTLP = f"struct<resourceSpans: array<struct<resource: struct<attributes: {_ATTRIBUTES}>, scopeSpans: array<struct<spans: array<{_SPAN}>>>>>>"


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """file, ord, entry, file_ord: a file that is one JSON value gives that value, or the elements of its list; any other file, or one of several lines of which the
    first is a JSON value by itself, gives a value for each line that is not blank.

    A line that is no JSON has a null entry; `files.problems` tells its number. ord orders the entries of a file: it counts from 0 in the first piece of a file and
    goes on with byte offsets, file_ord orders files. A file of lines is read by many tasks, one that is a single value by one."""
    found = files.trace_lines(spark, path, **options).where("text IS NOT NULL")
    whole = F.col("whole") & F.try_parse_json("text").isNotNull()
    listed = F.ltrim("text").startswith("[")
    lists = found.where(whole & listed).select("file", F.posexplode(F.from_json("text", "array<string>")).alias("ord", "entry"), "file_ord")
    values = found.where(whole & ~listed).select("file", F.lit(0).alias("ord"), F.trim("text").alias("entry"), "file_ord")
    parsed = lambda c: F.when(F.try_parse_json(c).isNotNull(), F.trim(c)).alias("entry")
    each = found.where(F.col("whole") & F.try_parse_json("text").isNull()).select("file", F.posexplode(F.split("text", "\n", -1)).alias("ord", "line"), "file_ord").where(F.trim("line") != "")
    lines = found.where(~F.col("whole")).select("file", F.when(F.col("start") == 0, F.col("filled")).otherwise(F.col("at")).alias("ord"), parsed("text"), "file_ord")
    return lists.unionByName(values).unionByName(each.select("file", "ord", parsed("line"), "file_ord")).unionByName(lines).withColumn("ord", F.col("ord").cast("long"))


def _get(path: str) -> Column:
    return F.get_json_object("entry", path)


def detect(entries: DataFrame) -> DataFrame:
    """file, source_format: otel, langfuse, claudecode, rawapi or unknown, the first that fits in this order."""
    first = F.col("ord") == 0
    has = lambda *p: F.coalesce(*(_get(x) for x in p)).isNotNull()
    otel = has("$.resourceSpans") | F.coalesce(_get("$.attributes"), F.lit("")).contains("gen_ai.")
    observations = has("$.observations") | (has("$.id") & ~has("$.traceId", "$.spans", "$.request", "$.response", "$.provider"))
    talk = _get("$.type").isin("user", "assistant", "progress", "system") & has("$.sessionId") & has("$.uuid")
    raw = has("$.request", "$.response", "$.provider")
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = entries.groupBy("file").agg(any_of(first & otel).alias("o"), any_of(first & observations).alias("l"), any_of((F.col("ord") < 10) & talk).alias("c"), any_of(first & raw).alias("r"))
    return flags.select("file", F.when(F.col("o"), "otel").when(F.col("l"), "langfuse").when(F.col("c"), "claudecode").when(F.col("r"), "rawapi").otherwise("unknown").alias("source_format"))


# Names by which a caller says the format of all files.
HINTS = {"otel": "otel", "langfuse": "langfuse", "claude_code": "claudecode", "raw": "rawapi"}


def unknown_files(entries: DataFrame) -> DataFrame:
    """file: those whose format is none of the four, which `normalize` gives no spans of."""
    return detect(entries).where("source_format = 'unknown'").select("file")


def normalize(entries: DataFrame, hint: str = "auto") -> DataFrame:
    """Spans of all files, each by its format, or by the one that hint names; files of unknown format have none (`unknown_files`)."""
    if hint not in ("auto", *HINTS):
        raise ValueError(f"no such format: {hint}; there are auto, {', '.join(HINTS)}")
    kinds = entries.join(detect(entries), "file") if hint == "auto" else entries.withColumn("source_format", F.lit(HINTS[hint]))
    of = lambda k: kinds.where(F.col("source_format") == k).drop("source_format")
    return otel(of("otel")).unionByName(observations(of("langfuse"))).unionByName(conversations(of("claudecode"))).unionByName(api_log(of("rawapi")))


def _spans(df: DataFrame, source_format: str, **columns: Column) -> DataFrame:
    kinds = {"span_ord": "long", "start_time": "timestamp", "end_time": "timestamp", "duration_ms": "double", "input_tokens": "long", "output_tokens": "long", "total_tokens": "long", "finish_reasons": "array<string>", "temperature": "double", "max_tokens": "long", "input_cost": "double", "output_cost": "double", "total_cost": "double"} | _NESTED
    columns |= {"source_format": F.lit(source_format)}
    # nested columns have their kind already; a cast would copy every element only to call its fields nullable
    return df.select(*((columns[c] if c in _NESTED and c in columns else columns.get(c, F.lit(None)).cast(kinds.get(c, "string"))).alias(c) for c in COLUMNS))


def _some(items: Column, of: Column | None = None) -> Column:
    """A list, or null if it is empty. of: the list that items are made of, one for one, so that they are not made twice, for their number and for themselves."""
    return F.when(F.size(items if of is None else of) > 0, items)


def _call(id: Column, name: Column, kind: Column, arguments: Column) -> Column:
    return F.struct(id.cast("string").alias("id"), F.coalesce(name, F.lit("unknown")).alias("name"), kind.cast("string").alias("type"), arguments.cast("string").alias("arguments"))


def _message(role: Column, content: Column) -> Column:
    return F.struct(role.cast("string").alias("role"), content.alias("content"))


def _known(**values: Column) -> Column:
    """A map of those values that are not null."""
    return F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string")))), lambda _, v: v.isNotNull())


def _said(texts: Column) -> Column:
    """Messages of a list of texts: a JSON object is a message, other JSON none, any other text is the content of one."""
    read = lambda t: F.from_json(t, "role string, content string")
    value = lambda t: F.try_parse_json(t)
    known = F.filter(texts, lambda t: value(t).isNull() | F.startswith(F.schema_of_variant(value(t)), F.lit("OBJECT")))
    return _some(F.transform(known, lambda t: F.when(value(t).isNull(), _message(F.lit(None), t)).otherwise(_message(read(t)["role"], read(t)["content"]))))


def _filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def _time(text: Column) -> Column:
    """A time from nanoseconds since 1970 or from ISO text; null if it is neither."""
    return F.when(text.rlike(r"^\d+$"), F.timestamp_micros(F.floor(text.try_cast("decimal(30,0)") / 1000).cast("long"))).otherwise(F.try_to_timestamp(text))


def _between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e3


def _whole(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("long"))


def _plain(attributes: Column) -> Column:
    """Attributes as a list of (key, value): a scalar as text, an array as its texts joined by the unit separator."""
    scalar = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"], v["boolValue"])
    value = lambda v: F.when(v["arrayValue"].isNotNull(), F.array_join(F.transform(v["arrayValue"]["values"], scalar), "\x1f")).otherwise(scalar(v))
    return F.transform(F.coalesce(attributes, F.array().cast(_ATTRIBUTES)), lambda a: F.struct(a["key"].alias("key"), value(a["value"]).alias("value")))


def otel(entries: DataFrame) -> DataFrame:
    """OTLP: resourceSpans, scopeSpans and spans are unnested; attributes of a span's events that begin with gen_ai. come over its own."""
    e = entries.withColumn("o", F.from_json("entry", OTLP.removeprefix("struct<").removesuffix(">").replace("resourceSpans:", "resourceSpans ", 1)))
    resource = e.select("file", "ord", F.posexplode("o.resourceSpans").alias("r", "rs"))
    with_session = resource.withColumn("session", F.get(F.filter(_plain(F.col("rs.resource.attributes")), lambda a: (a["key"] == "session.id") & (a["value"] != "")), 0)["value"])
    session = with_session.where(F.col("session").isNotNull()).groupBy("file").agg(F.min_by("session", F.struct("ord", "r")).alias("session_id"))
    spans = with_session.select("file", "ord", "r", F.posexplode("rs.scopeSpans").alias("s", "ss")).select("file", "ord", "r", "s", F.posexplode("ss.spans").alias("i", "x"))
    spans = spans.join(session, "file", "left").withColumn("own", _plain(F.col("x.attributes")))
    events = F.flatten(F.transform(F.coalesce("x.events", F.array().cast(f"array<struct<attributes: {_ATTRIBUTES}>>")), lambda v: F.filter(_plain(v["attributes"]), lambda a: a["key"].startswith("gen_ai."))))
    spans = spans.withColumn("all", F.concat("own", events))
    pick = lambda of, name: F.try_element_at(F.filter(of, lambda a: a["key"] == name), F.lit(-1))["value"]
    value = lambda *names: _filled(*(pick("all", n) for n in names))
    own = lambda name: _filled(pick("own", name))
    keys = F.transform("all", lambda a: F.lower(a["key"]))
    framework = F.get(F.filter(F.transform(keys, lambda k: F.when(k.contains("langgraph") | k.contains("langchain"), "langgraph").when(k.contains("crewai"), "crewai").when(k.contains("autogen"), "autogen").when(k.contains("google.adk"), "adk")), lambda x: x.isNotNull()), 0)
    operation = F.coalesce(value("gen_ai.operation.name"), F.lit("unknown"))
    op = F.lower(F.coalesce(value("gen_ai.operation.name"), F.lit("")))
    memory = lambda what: F.exists(keys, lambda k: k.contains("memory") & k.contains(what))
    kind = F.when(op.isin("chat", "text_completion", "embeddings"), "llm_generation").when((op == "tool_call") | value("gen_ai.tool.name").isNotNull(), "tool_call").when(value("gen_ai.agent.id").isNotNull() | (op == "agent"), "agent_handoff").when(memory("read"), "memory_read").when(memory("write"), "memory_write")
    start, end = _time(F.col("x.startTimeUnixNano")), _time(F.col("x.endTimeUnixNano"))
    failed = (F.col("x.status.code") == "2") | (F.col("x.status.statusCode") == "ERROR")
    trace = F.coalesce(_filled(F.col("x.traceId"), F.col("x.trace_id")), F.lit("unknown"))
    order = Window.partitionBy("file", "__trace").orderBy("ord", "r", "s", "i")
    spans = spans.withColumn("__trace", trace).withColumn("__n", F.row_number().over(order))
    return _spans(
        spans, "otel", trace_id=F.col("__trace"), span_ord=F.col("__n"), session_id=F.col("session_id"), span_id=F.coalesce(_filled(F.col("x.spanId"), F.col("x.span_id")), F.sha2(F.concat_ws(":", "file", "ord", "r", "s", "i"), 256)),
        parent_span_id=_filled(F.col("x.parentSpanId"), F.col("x.parent_span_id")), operation=operation, provider=value("gen_ai.provider.name", "gen_ai.system"), model_requested=value("gen_ai.request.model"), model_used=value("gen_ai.response.model"),
        start_time=start, end_time=end, duration_ms=_between(start, end), input_tokens=_whole(value("gen_ai.usage.input_tokens")), output_tokens=_whole(value("gen_ai.usage.output_tokens")), total_tokens=_whole(value("gen_ai.usage.total_tokens")),
        finish_reasons=F.split(value("gen_ai.response.finish_reasons"), "\x1f"), error_type=F.coalesce(own("error.type"), F.when(failed, "otel_error")), error_message=F.when(own("error.type").isNotNull(), F.coalesce(own("error.message"), own("exception.message"), F.lit(""))).when(failed, F.coalesce("x.status.message", F.lit("Unknown error"))),
        agent_id=value("gen_ai.agent.id", "graph.node.id"), agent_name=value("gen_ai.agent.name"), agent_framework=F.coalesce(framework, F.lower(value("gen_ai.agent.framework")), F.when(F.exists(keys, lambda k: k == "graph.node.id"), "langgraph")),
        span_kind=kind, tool_name=value("gen_ai.tool.name"), mcp_server_uri=value("gen_ai.mcp.server_uri", "mcp.server.uri"), input_messages=value("gen_ai.input.messages"), output_messages=value("gen_ai.output.messages"),
        response_id=value("gen_ai.response.id"), temperature=value("gen_ai.request.temperature").try_cast("double"), max_tokens=_whole(value("gen_ai.request.max_tokens")),
        messages_in=_said(F.split(value("gen_ai.input.messages"), "\x1f")), messages_out=_said(F.split(value("gen_ai.output.messages"), "\x1f")),
        tool_calls=F.when(value("gen_ai.tool.name").isNotNull() | value("gen_ai.tool.call.id").isNotNull(), F.array(_call(value("gen_ai.tool.call.id"), value("gen_ai.tool.name"), value("gen_ai.tool.type"), F.lit(None)))),
    )


_OBSERVATION = (
    "array<struct<" + ", ".join(f"{n}: string" for n in "id type name parentObservationId startTime endTime completionStartTime providedModelName model internalModel inputTokens promptTokens outputTokens completionTokens totalTokens latency level statusMessage input output inputCost outputCost totalCost".split())
    + ", metadata: struct<agent_id: string, agent_name: string, framework: string>, scores: array<struct<name: string, value: string, label: string, comment: string>>>>"
)
_EXPORT = ("id", "traceId", "sessionId", "name", "userId", "tags", "version", "release")
_TOOLS = "tool_calls array<struct<id: string, name: string, function: struct<name: string, arguments: string>>>"


def observations(entries: DataFrame) -> DataFrame:
    """Observation exports: a trace for each entry that has observations, or for each element of its list `data`. Token counts of 0 are read as the other name's, or null.

    tool_calls are those of an output that is an object, evaluations the scores; a score that is no number has a null score_value."""
    trace = "struct<" + ", ".join(f"{n}: string" for n in _EXPORT) + f", observations: {_OBSERVATION}>"
    e = entries.withColumn("o", F.from_json("entry", f"{trace[7:-1].replace(': ', ' ', len(_EXPORT)).replace('observations: ', 'observations ', 1)}, data array<{trace}>"))
    one = F.struct(*(F.col(f"o.{n}").alias(n) for n in (*_EXPORT, "observations")))
    traces = e.select("file", "ord", F.explode(F.coalesce("o.data", F.array(one))).alias("t"))
    # a trace's own columns are taken out before its observations are, of which each row would carry all others; outputs are parsed once, by a step of their own
    about = _known(**{n: F.col(f"t.{n}") for n in _EXPORT[2:]})
    traces = traces.select("file", "ord", F.coalesce(_filled(F.col("t.id"), F.col("t.traceId")), F.lit("unknown")).alias("trace"), F.col("t.sessionId").alias("session"), about.alias("about"), "t.observations")
    x = traces.select("trace", "session", "about", F.posexplode("observations").alias("i", "x")).select("*", F.from_json("x.output", _TOOLS)["tool_calls"].alias("tools"))
    calls = F.transform("tools", lambda c: _call(c["id"], F.coalesce(c["function"]["name"], c["name"]), F.lit("function"), c["function"]["arguments"]))
    scores = F.transform("x.scores", lambda v: F.struct(F.coalesce(v["name"], F.lit("unnamed")).alias("name"), v["value"].try_cast("double").alias("score_value"), v["label"].alias("score_label"), v["comment"].alias("explanation")))
    whole = lambda c: F.when(_filled(c).isNotNull(), F.array(_message(F.lit(None), c)))
    kind = F.upper(F.coalesce("x.type", F.lit("SPAN")))
    model = _filled(F.col("x.providedModelName"), F.col("x.model"))
    low = F.lower(model)
    provider = F.when(low.contains("gpt") | low.contains("o1") | low.contains("o3"), "openai").when(low.contains("claude"), "anthropic").when(low.contains("gemini"), "google")
    start, end = F.try_to_timestamp("x.startTime"), F.try_to_timestamp(_filled(F.col("x.endTime"), F.col("x.completionStartTime")))
    tokens = lambda *names: F.coalesce(*(F.nullif(_whole(F.col(f"x.{n}")), F.lit(0).cast("long")) for n in names))
    handoff = F.lower(F.coalesce("x.name", F.lit(""))).rlike("handoff|delegate|route")
    return _spans(
        x, "langfuse", trace_id=F.col("trace"), span_ord=F.col("i") + 1, session_id=F.col("session"), span_id=F.coalesce("x.id", F.lit("unknown")), parent_span_id=F.col("x.parentObservationId"),
        operation=F.when(kind == "GENERATION", "chat").when(kind == "SPAN", "agent").when(kind == "EVENT", "event").otherwise("unknown"), provider=provider, model_requested=model, model_used=F.coalesce(_filled(F.col("x.internalModel")), model), start_time=start, end_time=end,
        duration_ms=F.coalesce(F.col("x.latency").try_cast("double") * 1000, _between(start, end)), input_tokens=tokens("inputTokens", "promptTokens"), output_tokens=tokens("outputTokens", "completionTokens"), total_tokens=_whole(F.col("x.totalTokens")),
        error_type=F.when(F.col("x.level") == "ERROR", "error"), error_message=F.col("x.statusMessage"), agent_id=F.col("x.metadata.agent_id"), agent_name=F.coalesce(_filled(F.col("x.metadata.agent_name")), F.when(kind == "SPAN", F.col("x.name"))), agent_framework=F.col("x.metadata.framework"),
        span_kind=F.when(kind == "GENERATION", "llm_generation").when((kind == "SPAN") & handoff, "agent_handoff"), input_messages=_filled(F.col("x.input")), output_messages=_filled(F.col("x.output")),
        input_cost=F.col("x.inputCost").try_cast("double"), output_cost=F.col("x.outputCost").try_cast("double"), total_cost=F.col("x.totalCost").try_cast("double"), messages_in=whole(F.col("x.input")), messages_out=whole(F.col("x.output")), tool_calls=_some(calls, F.col("tools")), evaluations=_some(scores, F.col("x.scores")), metadata=F.col("about"),
    )


def api_log(entries: DataFrame) -> DataFrame:
    """API logs: a trace of one span for each entry; ids that are missing come from a hash of file and place."""
    own = F.sha2(F.concat_ws(":", "file", "ord"), 256)
    error = F.coalesce(_get("$.error"), _get("$.response.error"))
    reason = F.from_json(_get("$.response.choices[*].finish_reason"), "array<string>")
    reasons = F.when(_get("$.response.choices[*].finish_reason").startswith("["), reason).when(_get("$.response.choices[*].finish_reason").isNotNull(), F.array(F.regexp_replace(_get("$.response.choices[*].finish_reason"), '^"|"$', "")))
    model = _filled(_get("$.model"), _get("$.request.model"), _get("$.response.model"))
    tokens = lambda a, b: _whole(F.coalesce(_get(f"$.tokens.{a}"), _get(f"$.response.usage.{a}"), _get(f"$.response.usage.{b}")))
    return _spans(
        entries.where(F.col("entry").isNotNull()), "rawapi", trace_id=F.coalesce(_get("$.trace_id"), own), span_ord=F.lit(1), span_id=F.coalesce(_filled(_get("$.id"), _get("$.response.id")), own), operation=F.coalesce(_get("$.operation"), F.lit("chat")), provider=_get("$.provider"),
        model_requested=F.coalesce(_filled(_get("$.request.model")), model), model_used=F.coalesce(_get("$.response.model"), model), start_time=F.try_to_timestamp(_get("$.timestamp")), end_time=F.try_to_timestamp(_get("$.end_timestamp")), duration_ms=F.coalesce(_get("$.latency_ms"), _get("$.duration_ms")).try_cast("double"),
        input_tokens=tokens("input", "prompt_tokens"), output_tokens=tokens("output", "completion_tokens"), total_tokens=tokens("total", "total_tokens"), finish_reasons=reasons,
        error_type=F.when(error.isNotNull(), F.coalesce(_get("$.error.type"), _get("$.response.error.type"), F.lit("api_error"))), error_message=F.coalesce(_get("$.error.message"), _get("$.response.error.message"), error), input_messages=_get("$.request.messages"), response_id=_get("$.response.id"), temperature=_get("$.request.temperature").try_cast("double"), max_tokens=_whole(_get("$.request.max_tokens")), messages_in=_some(F.from_json(_get("$.request.messages"), _MESSAGES)),
    )


def conversations(entries: DataFrame) -> DataFrame:
    """Conversation logs: a trace for each session, a span for each assistant message; its input is the latest user entry that no earlier message took."""
    kind = F.coalesce(_get("$.type"), F.lit(""))
    e = entries.where(_get("$.sessionId").isNotNull()).select("*", _get("$.sessionId").alias("session"), kind.alias("kind"), _get("$.message.type").alias("message_type"), _get("$.message.content").alias("content"))
    talks = (F.col("kind") == "user") | ((F.col("kind") == "assistant") & (F.col("message_type") == "message"))
    w = Window.partitionBy("file", "session").orderBy("ord")
    is_list = F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get(F.try_parse_json("entry"), "$.message.content", "variant")), F.lit("ARRAY")), F.lit(False))
    about = _known(**{n: _get(f"$.{n}") for n in ("version", "gitBranch", "cwd", "permissionMode")})
    # what other kinds of entries say is not needed but for the first entry's settings, so it is not shuffled
    e = e.select("file", "ord", "session", "kind", talks.alias("talks"), "content", is_list.alias("is_list"), about.alias("about"), F.when(F.col("kind") == "assistant", F.col("entry")).alias("entry"))
    e = e.withColumn("about", F.first("about").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("talks")
    e = e.withColumn("g", F.sum(F.when(F.col("kind") == "user", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_group = Window.partitionBy("file", "session", "g").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("nth", F.sum(F.when(F.col("kind") == "assistant", 1).otherwise(0)).over(in_group)).withColumn("said", F.first(F.when(F.col("kind") == "user", F.col("content")), ignorenulls=True).over(in_group))
    e = e.withColumn("said_list", F.first(F.when((F.col("kind") == "user") & F.col("content").isNotNull(), F.col("is_list")), ignorenulls=True).over(in_group))
    block = "array<struct<type: string, text: string, name: string, id: string, input: string>>"
    blocks = F.when(F.col("is_list"), F.from_json("content", block))
    asked = F.transform(F.filter(F.from_json("said", block), lambda b: b["type"] == "text"), lambda b: _message(F.lit("user"), F.coalesce(b["text"], F.lit(""))))
    asked = F.when(F.col("said_list"), _some(asked)).when(F.col("said").isNotNull(), F.array(_message(F.lit("user"), F.col("said"))))
    uses = F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: _call(b["id"], b["name"], F.lit("function"), b["input"]))
    texts = F.filter(blocks, lambda b: (b["type"] == "text") & (b["text"] != ""))
    e = e.where("kind = 'assistant'").withColumn("n", F.row_number().over(w))
    usage = lambda name: _whole(_get(f"$.message.usage.{name}"))
    extra = lambda name: F.coalesce(usage(name), F.lit(0).cast("long"))
    taken = usage("input_tokens") + extra("cache_creation_input_tokens") + extra("cache_read_input_tokens")
    tool = F.get(F.filter(blocks, lambda b: b["type"] == "tool_use"), 0)["name"]
    return _spans(
        e, "claudecode", trace_id=F.col("session"), span_ord=F.col("n"), session_id=F.col("session"), span_id=_get("$.uuid"), parent_span_id=_get("$.parentUuid"), operation=F.lit("chat"), provider=F.lit("anthropic"), model_requested=_get("$.message.model"), model_used=_get("$.message.model"),
        start_time=F.try_to_timestamp(_get("$.timestamp")), input_tokens=taken, output_tokens=usage("output_tokens"), total_tokens=taken + usage("output_tokens"), finish_reasons=F.when(_get("$.message.stop_reason").isNotNull(), F.array(_get("$.message.stop_reason"))),
        span_kind=F.lit("llm_generation"), tool_name=tool, input_messages=F.when(F.col("nth") == 1, F.col("said")), output_messages=F.when(F.size(texts) > 0, F.to_json(F.transform(texts, lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text"), b["name"].alias("name"))))),
        end_time=F.try_to_timestamp(_get("$.timestamp")), response_id=_get("$.message.id"), messages_in=F.when(F.col("nth") == 1, asked), messages_out=_some(F.transform(texts, lambda b: _message(F.lit("assistant"), b["text"]))), tool_calls=_some(uses), metadata=F.col("about"),
    )
