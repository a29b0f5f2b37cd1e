"""Delegation graphs of traces: edges, roots, depths, paths, cycles, summaries of agents and what is made of their scores.

Depths, paths and cycles are found by doubling: in each round the known part of every way up becomes twice as long, so a way of a million spans takes
twenty rounds, and only ways that go on take part. Rounds are joins keyed by trace and span and are cut. No trace is gathered in one task.
Penalties are in `penalties.py`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import cut, release

OVERSIGHT = ("human_review", "human_approval", "human_oversight", "approval")


def edges(spans: DataFrame) -> DataFrame:
    """trace_id, parent_id, child_id, child_ord for spans whose parent is in their trace."""
    c = spans.where(F.col("parent_span_id").isNotNull()).select("trace_id", F.col("parent_span_id").alias("parent_id"), F.col("span_id").alias("child_id"), F.col("span_ord").alias("child_ord"))
    return c.join(spans.select("trace_id", F.col("span_id").alias("parent_id")).distinct(), ["trace_id", "parent_id"], "left_semi")


def roots(spans: DataFrame) -> DataFrame:
    """Spans without a parent, or whose parent is not in their trace."""
    known = spans.select("trace_id", F.col("span_id").alias("parent_span_id")).distinct()
    orphans = spans.where(F.col("parent_span_id").isNotNull()).join(known, ["trace_id", "parent_span_id"], "left_anti")
    return spans.where(F.col("parent_span_id").isNull()).select("trace_id", "span_id").unionByName(orphans.select("trace_id", "span_id"))


def depths(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, depth: the longest way from a root; -1 for spans that none reaches, as in a cycle. Of a repeated span id all parents count."""
    nodes = spans.select("trace_id", "span_id").distinct()
    sizes = cut(nodes.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")))
    best = cut(nodes.join(roots(spans).distinct().withColumn("depth", F.lit(0)), ["trace_id", "span_id"], "left"))
    # far: y stands `reach` steps above x
    far, reach = cut(edges(spans).select("trace_id", F.col("child_id").alias("x"), F.col("parent_id").alias("y")).distinct()), 1
    while far.limit(1).count():
        above = best.where("depth IS NOT NULL").select("trace_id", F.col("span_id").alias("y"), F.col("depth").alias("of_y"))
        longer = far.join(above, ["trace_id", "y"]).groupBy("trace_id", F.col("x").alias("span_id")).agg((F.max("of_y") + reach).alias("longer"))
        better = cut(best.join(longer, ["trace_id", "span_id"], "left").select("trace_id", "span_id", F.greatest("depth", "longer").alias("depth")))
        # a way as long as its trace has spans goes round and round
        on = far.select("trace_id", F.col("x").alias("y"), F.col("y").alias("z"))
        farther = cut(far.join(sizes.where(F.col("n") > 2 * reach), "trace_id", "left_semi").join(on, ["trace_id", "y"]).select("trace_id", "x", F.col("z").alias("y")).distinct())
        release(best, far)
        best, far, reach = better, farther, 2 * reach
    return best.select("trace_id", "span_id", F.coalesce("depth", F.lit(-1)).alias("depth"))


def paths(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, delegation_path: agents from the root down, each where it stands nearest the span.

    The ancestors of a span are gathered by walking up, in joins of which each doubles the known part of the way, until every way has ended. A cycle's way
    comes round to agents that it knows; it is whole when it is as long as its trace has spans. All joins are by trace, on the partitioning of the first."""
    own = spans.select("trace_id", "span_id", F.when(F.col("agent_id") != "", F.col("agent_id")).alias("agent"), "parent_span_id")
    way = cut(own.select("trace_id", "span_id", F.filter(F.array("agent"), lambda x: x.isNotNull()).alias("chain"), F.col("parent_span_id").alias("next")))
    sizes, reach = way.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")), 1
    while way.where("next IS NOT NULL").join(sizes.where(F.col("n") > reach), "trace_id", "left_semi").limit(1).count():
        ahead = way.select("trace_id", F.col("span_id").alias("next"), F.col("chain").alias("more"), F.col("next").alias("then"))
        chain = F.array_distinct(F.concat("chain", F.coalesce("more", F.array().cast("array<string>"))))
        way = cut(way.join(ahead, ["trace_id", "next"], "left").select("trace_id", "span_id", chain.alias("chain"), F.col("then").alias("next")))
        reach *= 2
    return way.select("trace_id", "span_id", F.reverse("chain").alias("delegation_path"))


def several_agents(spans: DataFrame) -> DataFrame:
    """trace_id of the traces in which more than one agent is named; '' and null name none."""
    named = F.nullif(F.col("agent_id"), F.lit(""))
    return spans.groupBy("trace_id").agg(F.min(named).alias("a"), F.max(named).alias("b")).where("a < b").select("trace_id")


def adjacency(spans: DataFrame, part: int = 10_000) -> DataFrame:
    """trace_id, parent_id, part, children: of each span its children in the order of span_ord, in lists of at most `part` places each, so that a span with very many children is several rows.

    A child of a repeated place is in the same list, by its id; a child whose parent is not in its trace is in none."""
    e = edges(spans).withColumn("part", F.expr(f"(coalesce(child_ord, 1) - 1) div {part}").cast("long"))
    lists = e.groupBy("trace_id", "parent_id", "part").agg(F.array_sort(F.collect_list(F.struct("child_ord", "child_id"))).alias("x"))
    return lists.select("trace_id", "parent_id", "part", F.transform("x", lambda c: c["child_id"]).alias("children"))


def enriched(spans: DataFrame) -> DataFrame:
    """spans with delegation_path, the agents from the root down, in traces of several agents; null in others, of which nothing is walked. All rows stay, of repeated span ids too."""
    multi = several_agents(spans)
    walked = paths(spans.join(multi, "trace_id", "left_semi")).dropDuplicates(["trace_id", "span_id"])
    return spans.join(walked, ["trace_id", "span_id"], "left")


def agent_summary(spans: DataFrame) -> DataFrame:
    """Of each agent of a trace ('' and null: _unknown): spans, first name, oversight, deepest span."""
    named = spans.withColumn("agent", F.coalesce(F.nullif(F.col("agent_id"), F.lit("")), F.lit("_unknown")))
    oversight = F.coalesce(F.lower("operation").isin(*OVERSIGHT), F.lit(False)) | F.coalesce(F.lower("span_kind").isin(*OVERSIGHT), F.lit(False))
    deep = named.join(depths(spans), ["trace_id", "span_id"])
    return deep.groupBy("trace_id", "agent").agg(F.count(F.lit(1)).alias("n_spans"), F.min_by("agent_name", "span_ord").alias("agent_name"), F.bool_or(oversight).alias("has_oversight"), F.greatest(F.lit(0), F.max("depth")).alias("max_depth"))


def unsupervised(summary: DataFrame) -> DataFrame:
    return summary.where(~F.col("has_oversight") & (F.col("agent") != "_unknown")).select("trace_id", "agent")


def agent_edges(spans: DataFrame) -> DataFrame:
    """trace_id, from_agent, to_agent: distinct delegations between different agents."""
    agent = F.coalesce(F.nullif(F.col("agent_id"), F.lit("")), F.lit("_unknown"))
    of = spans.select("trace_id", "span_id", agent.alias("agent"))
    e = edges(spans)
    out = e.join(of.select("trace_id", F.col("span_id").alias("parent_id"), F.col("agent").alias("from_agent")), ["trace_id", "parent_id"]).join(of.select("trace_id", F.col("span_id").alias("child_id"), F.col("agent").alias("to_agent")), ["trace_id", "child_id"])
    return out.where("from_agent <> to_agent").select("trace_id", "from_agent", "to_agent").distinct()


def turning_back(spans: DataFrame) -> DataFrame:
    """trace_id of the traces in which a span's parent does not stand before it by span_ord; a cycle cannot go back in every step. A parent of several rows stands where its last
    one does, and one without a place after all."""
    own = spans.select("trace_id", "span_id", F.coalesce("span_ord", F.lit(2**63 - 1)).alias("at"), F.lit(None).cast("long").alias("child_at"))
    asked = spans.where(F.col("parent_span_id").isNotNull()).select("trace_id", F.col("parent_span_id").alias("span_id"), F.lit(None).cast("long").alias("at"), F.coalesce("span_ord", F.lit(-(2**63))).alias("child_at"))
    each = own.unionByName(asked).groupBy("trace_id", "span_id").agg(F.max("at").alias("at"), F.min("child_at").alias("child_at"))
    return each.where("at >= child_at").select("trace_id").distinct()


def cycles(spans: DataFrame) -> DataFrame:
    """trace_id, cycle: each cycle of parents once, from its lowest span id on. Of a repeated span id the first row's parent counts.

    What spans is made of is computed once, and only traces that can have a cycle are walked."""
    whole = cut(spans.select("trace_id", "span_id", "parent_span_id", "span_ord"))
    spans = cut(whole.join(turning_back(whole), "trace_id", "left_semi"))
    release(whole)
    e = edges(spans).groupBy("trace_id", F.col("child_id").alias("a")).agg(F.min_by("parent_id", F.struct(F.coalesce("child_ord", F.lit(2**63 - 1)), "parent_id")).alias("to"))
    # Only spans that no root reaches can be on a cycle; where there are none, as in sound traces, nothing is walked.
    lost = depths(spans).where("depth = -1").select("trace_id", F.col("span_id").alias("a"))
    step = cut(e.join(lost, ["trace_id", "a"], "left_semi"))
    longest = step.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0
    # to: `reach` steps up from a; low: the lowest id among a and what lies before `to`. After as many steps as there are spans every way is on its cycle.
    way, reach = cut(step.withColumn("low", F.col("a"))), 1
    while reach < longest:
        on = way.select("trace_id", F.col("a").alias("to"), F.col("to").alias("then"), F.col("low").alias("their"))
        farther = cut(way.join(on, ["trace_id", "to"]).select("trace_id", "a", F.col("then").alias("to"), F.least("low", "their").alias("low")))
        release(way)
        way, reach = farther, 2 * reach
    ring = way.join(way.select("trace_id", F.col("to").alias("a")).distinct(), ["trace_id", "a"], "left_semi").select("trace_id", "a", "low")
    # left: steps from a up to the lowest of its cycle, known when `to` is that
    rank, reach = cut(step.join(ring, ["trace_id", "a"]).select("trace_id", "a", "low", "to", F.lit(1).alias("left"))), 1
    while reach < longest:
        on = rank.where("a <> low").select("trace_id", F.col("a").alias("to"), F.col("to").alias("then"), F.col("left").alias("more"))
        farther = cut(rank.join(on, ["trace_id", "to"], "left").select("trace_id", "a", "low", F.coalesce("then", "to").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
        release(rank)
        rank, reach = farther, 2 * reach
    # the lowest comes first, its parent next, which has the longest way left
    place = F.when(F.col("a") == F.col("low"), F.lit(0)).otherwise(F.lit(1))
    listed = rank.groupBy("trace_id", "low").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), (-F.col("left")).alias("l"), "a"))).alias("c"))
    return listed.select("trace_id", F.transform("c", lambda x: x["a"]).alias("cycle"))


def system_score(scores: DataFrame) -> DataFrame:
    """trace_id, system_score: final scores weighted by spans, to four places, half to even."""
    return scores.groupBy("trace_id").agg(F.bround(F.sum(F.col("final_score") * F.col("n_spans")) / F.sum("n_spans"), 4).alias("system_score"))


def liability_shifts(spans: DataFrame) -> DataFrame:
    """Traces that use more than one model or more than one framework, with their sorted lists."""
    models = F.array_sort(F.collect_set(F.nullif(F.col("model_used"), F.lit(""))))
    frameworks = F.array_sort(F.collect_set(F.nullif(F.col("agent_framework"), F.lit(""))))
    out = spans.groupBy("trace_id").agg(models.alias("m"), frameworks.alias("f"))
    return out.where((F.size("m") > 1) | (F.size("f") > 1)).select("trace_id", F.array_join("m", ", ").alias("models"), F.array_join("f", ", ").alias("frameworks"), (F.size("m") > 1).alias("several_models"), (F.size("f") > 1).alias("several_frameworks"))


def merged(scores: DataFrame) -> DataFrame:
    """agent, final_score over all traces: that of the last trace counts."""
    return scores.groupBy("agent").agg(F.max_by("final_score", "trace_id").alias("final_score"))
