"""Spans written as nested JSON and read back: an object for each trace with its spans in order.

A trace is cut into objects of at most PART spans, each with the number of its part, so that a trace that holds a third of all spans is
written by many tasks and no object or group is larger than that. Objects are lines, so files are read in pieces again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = 10_000
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
_OF_TRACE = ("source_format", "session_id", "metadata")


def nested(spans: DataFrame, part: int = PART) -> DataFrame:
    """trace_id, part, what spans has of source_format, session_id and metadata, and spans: the other columns, ordered by span_ord.

    Spans of one place are in the order of their values as JSON; those without a place come first, in part 0. What belongs to the trace is taken from a part's first span."""
    one = F.struct(*(F.col(c).alias(c) for c in spans.columns if c != "trace_id"))
    key = F.struct(F.col("span_ord"), F.to_json(one), one.alias("span"))
    groups = spans.select("trace_id", F.coalesce(F.expr(f"(span_ord - 1) div {part}"), F.lit(0)).cast("long").alias("part"), key.alias("x"))
    # maps cannot be compared, so lists are ordered by place and text alone
    order = lambda a, b: F.when(a["span_ord"].isNull() & b["span_ord"].isNotNull(), -1).when(b["span_ord"].isNull() & a["span_ord"].isNotNull(), 1).when(a["span_ord"] < b["span_ord"], -1).when(a["span_ord"] > b["span_ord"], 1).when(a["col2"] < b["col2"], -1).when(a["col2"] > b["col2"], 1).otherwise(0)
    lists = groups.groupBy("trace_id", "part").agg(F.array_sort(F.collect_list("x"), order).alias("xs")).withColumn("spans", F.transform("xs", lambda x: x["span"]))
    kept = [c for c in _OF_TRACE if c in spans.columns]
    return lists.select("trace_id", "part", *(F.get("spans", 0)[c].alias(c) for c in kept), F.transform("spans", lambda x: x.dropFields(*kept) if kept else x).alias("spans"))


def write(spans: DataFrame, path: str, part: int = PART, mode: str = "errorifexists") -> None:
    """Writes nested(spans) into a folder of JSON lines; fields that are null are left out."""
    nested(spans, part).write.mode(mode).option("timestampFormat", TIME).option("timestampNTZFormat", TIME.removesuffix("XXX")).option("compression", "none").json(path)


def read(entries: DataFrame, schema: T.StructType) -> DataFrame:
    """Spans out of entries of `traces.load` that `write` wrote, with the columns of schema; an entry that is no such object gives none."""
    kept = [f for f in schema.fields if f.name in _OF_TRACE]
    own = T.StructType([f for f in schema.fields if f.name not in ("trace_id", *_OF_TRACE)])
    whole = T.StructType([T.StructField("trace_id", T.StringType()), *kept, T.StructField("spans", T.ArrayType(own))])
    options = {"timestampFormat": TIME, "timestampNTZFormat": TIME.removesuffix("XXX")}
    x = entries.select(F.from_json("entry", whole, options).alias("o")).select("o.trace_id", *(f"o.{f.name}" for f in kept), F.explode("o.spans").alias("s"))
    return x.select(*(F.col(c) if c == "trace_id" or c in _OF_TRACE else F.col(f"s.{c}") for c in schema.names))
