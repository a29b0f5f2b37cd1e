"""Penalties of agents for what their delegates lack, from the leaves of the graph of agents up.

Traces of bounded size are dealt out many at a time, and a task solves its traces in one pass over their delegations. What is larger stays spread over all tasks:
leaves are solved, chains of agents that wait for a single delegate are folded into one function by doubling and solved with their end, and so on with
what is left. A chain of a million agents takes twenty rounds, and a tree as many turns as its branches meet, not as many as it is high.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import cut, release

PENALTY_WEIGHT, SATISFIED = 0.5, 0.95
#: Agents and delegations of a trace that one task may solve, and of the traces that one task solves together, about.
SMALL, TOGETHER = 100_000, 20_000
KEY = ["trace_id", "agent"]
_PIECES = T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in ("start", "slope", "base")]))


def lost(final: float) -> float:
    """What an agent loses for a delegate with this final score."""
    return PENALTY_WEIGHT * (1 - final) if final < SATISFIED else 0.0


def _lost(final: Column) -> Column:
    return F.when(final < SATISFIED, PENALTY_WEIGHT * (1 - final)).otherwise(0.0)


def penalties(agents: DataFrame, delegations: DataFrame, small: int = SMALL) -> DataFrame:
    """agents (trace_id, agent, own_score) with penalty and final_score; delegations (trace_id, from_agent, to_agent) of which agents do not know an end do not count.

    For each delegate below 0.95 an agent loses half of what the delegate lacks. An agent is solved once all its delegates are. Agents of which that never
    comes true are on cycles, or lead to or from one; of those that lie on cycles or between them, the one with the higher id is solved first, and counts for the
    others with its final score, while they count for it with their own. Scores of traces beyond `small` may differ from those of a plain recursion by rounding."""
    agents = cut(agents.select(*KEY, "own_score"))
    known, ends = agents.select(*KEY), agents.select("trace_id", F.col("agent").alias("to"))
    edges = delegations.select("trace_id", F.col("from_agent").alias("agent"), F.col("to_agent").alias("to")).distinct()
    graph = cut(edges.join(known, KEY, "left_semi").join(ends, ["trace_id", "to"], "left_semi").select(*KEY, "to"))
    rows = agents.select(*KEY, "own_score", F.lit(None).cast(graph.schema["to"].dataType).alias("to")).unionByName(graph.withColumn("own_score", F.lit(None).cast("double")))
    sizes = cut(rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.sum(F.when(F.col("n") <= small, F.col("n"))).alias("small"), F.count_if(F.col("n") > small).alias("large")).first()
    large = sizes.where(F.col("n") > small)
    mine = rows.join(large, "trace_id", "left_anti") if total["large"] else rows
    bucket = F.pmod(F.xxhash64("trace_id"), F.lit(max(1, -(-(total["small"] or 0) // TOGETHER)))).alias("bucket")
    kind = agents.schema
    out = mine.select(bucket, *KEY, "to", "own_score").groupBy("bucket").applyInArrow(_solve, f"trace_id {kind['trace_id'].dataType.simpleString()}, agent {kind['agent'].dataType.simpleString()}, own_score double, penalty double")
    if total["large"]:
        out = out.unionByName(spread(agents.join(large, "trace_id", "left_semi"), graph.join(large, "trace_id", "left_semi")))
    return out.withColumn("final_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("own_score") - F.col("penalty"))))


def _solve(bucket: pa.Table) -> pa.Table:
    """All traces of a bucket: agents are the rows without `to`."""
    traces, agents, to, own = (bucket[c].to_pylist() for c in ("trace_id", "agent", "to", "own_score"))
    score, delegates = {}, defaultdict(list)
    for t, a, d, o in zip(traces, agents, to, own, strict=True):
        if d is None:
            score[t, a] = o
        else:
            delegates[t, a].append((t, d))
    penalty = solved(score, delegates)
    t, a = zip(*score, strict=True)
    kinds = bucket.schema
    return pa.table({"trace_id": pa.array(t, kinds.field("trace_id").type), "agent": pa.array(a, kinds.field("agent").type), "own_score": pa.array(score.values(), pa.float64()), "penalty": pa.array((penalty[x] for x in score), pa.float64())})


def solved(own: dict, delegates: dict) -> dict:
    """Penalties of agents by the rule of `penalties`, in one pass over the delegations and one more over those on cycles."""
    left = {a: len(delegates.get(a, ())) for a in own}
    above = defaultdict(list)
    for a, ds in delegates.items():
        for d in ds:
            above[d].append(a)
    penalty, found = dict.fromkeys(own, 0.0), set()

    def up(ready: list) -> None:
        while ready:
            a = ready.pop()
            found.add(a)
            less = lost(max(0.0, own[a] - penalty[a]))
            for x in above[a]:
                if (x, a) not in broken:
                    penalty[x] += less
                    left[x] -= 1
                    if not left[x]:
                        ready.append(x)

    broken: set = set()
    up([a for a, n in left.items() if not n])
    if len(found) < len(own):
        # of what is left, take away from above what only leads to cycles
        stuck = set(own) - found
        over = {a: sum(x in stuck for x in above[a]) for a in stuck}
        outside = [a for a, n in over.items() if not n]
        while outside:
            a = outside.pop()
            stuck.discard(a)
            for d in delegates.get(a, ()):
                if d in over and d in stuck:
                    over[d] -= 1
                    if not over[d]:
                        outside.append(d)
        for a in stuck:
            for d in delegates[a]:
                if d in stuck and d < a:
                    broken.add((a, d))
                    penalty[a] += lost(max(0.0, own[d]))
                    left[a] -= 1
        up([a for a in stuck if not left[a]])
    return penalty


def single(own: float) -> list[tuple[float, float, float]]:
    """An agent's final score as a function of its only open delegate's, by pieces (start, slope, base); own: its score less what it has lost already."""
    first = 1 - own / PENALTY_WEIGHT
    pieces = [(0.0, 0.0, 0.0)] if first > 0 else []
    if first < SATISFIED:
        pieces.append((max(0.0, first), PENALTY_WEIGHT, own - PENALTY_WEIGHT))
    return [*pieces, (SATISFIED, 0.0, max(0.0, own))]


def chained(outer: list, inner: list) -> list[tuple[float, float, float]]:
    """outer(inner(x)) of two rising functions by pieces, from 0 on."""
    out = []
    for i, (start, slope, base) in enumerate(inner):
        until = inner[i + 1][0] if i + 1 < len(inner) else float("inf")
        for j, (begin, steep, height) in enumerate(outer):
            end = outer[j + 1][0] if j + 1 < len(outer) else float("inf")
            if slope == 0:
                if not (begin <= base < end or (j == 0 and base < begin)):
                    continue
                low = start
            else:
                low = max(start, (begin - base) / slope) if j else start
                if low >= min(until, (end - base) / slope):
                    continue
            piece = (low, steep * slope, steep * base + height)
            if not out or out[-1][1:] != piece[1:]:
                out.append(piece)
    return out


@F.pandas_udf(_PIECES)
def _single(own: pd.Series) -> pd.Series:
    return own.map(lambda x: [dict(zip(("start", "slope", "base"), p, strict=True)) for p in single(x)])


@F.pandas_udf(_PIECES)
def _chained(outer: pd.Series, inner: pd.Series) -> pd.Series:
    plain = lambda f: [(p["start"], p["slope"], p["base"]) for p in f]
    return pd.Series([[dict(zip(("start", "slope", "base"), p, strict=True)) for p in chained(plain(f), plain(g))] for f, g in zip(outer, inner, strict=True)], dtype=object)


def _at(pieces: str, x: str) -> Column:
    """The value of a function by pieces."""
    p = F.element_at(F.filter(pieces, lambda p: (p["start"] <= F.col(x)) | (p["start"] == 0)), -1)
    return p["slope"] * F.col(x) + p["base"]


def spread(agents: DataFrame, graph: DataFrame) -> DataFrame:
    """trace_id, agent, own_score, penalty, for traces of any size: all work is joins and sums by trace and agent."""
    state = cut(agents.select(*KEY, "own_score", F.lit(None).cast("double").alias("penalty")))
    edges = cut(graph.select(*KEY, "to", F.lit(False).alias("broken")))
    waiting = state.count()
    while waiting:
        target = state.select("trace_id", F.col("agent").alias("to"), F.col("own_score").alias("o"), F.col("penalty").alias("p"))
        final = F.when(F.col("broken"), F.greatest(F.lit(0.0), "o")).when(F.col("p").isNotNull(), F.greatest(F.lit(0.0), F.col("o") - F.col("p")))
        of = edges.join(target, ["trace_id", "to"]).groupBy(*KEY).agg(F.count_if(final.isNull()).alias("open"), F.sum(_lost(final)).alias("lost"), F.min(F.when(final.isNull(), F.col("to"))).alias("next"))
        now = cut(state.join(of, KEY, "left").select(*KEY, "own_score", "penalty", F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("lost", F.lit(0.0)).alias("lost"), "next"))
        rest = F.col("penalty").isNull()
        raked = now.withColumn("penalty", F.when(rest & (F.col("open") == 0), F.col("lost")).otherwise(F.col("penalty")))
        solved_now = cut(raked.where("penalty IS NOT NULL").select(*KEY, F.greatest(F.lit(0.0), F.col("own_score") - F.col("penalty")).alias("final")))
        # chains of agents with one open delegate each: every part of the way, folded, is joined to the next one until it ends at an agent of another kind
        way = cut(raked.where(rest & (F.col("open") == 1)).select(*KEY, F.col("next").alias("to"), _single(F.col("own_score") - F.col("lost")).alias("fn")))
        reach, most = 1, way.count()
        while reach < 2 * most:
            on = way.select("trace_id", F.col("agent").alias("to"), F.col("to").alias("then"), F.col("fn").alias("inner"))
            both = way.join(on, ["trace_id", "to"], "left")
            if not way.join(on, ["trace_id", "to"], "left_semi").limit(1).count():
                break
            longer = cut(both.where("inner IS NOT NULL").select(*KEY, F.col("then").alias("to"), _chained("fn", "inner").alias("fn")).unionByName(both.where("inner IS NULL").select(*KEY, "to", "fn")))
            release(way)
            way, reach = longer, 2 * reach
        ends = solved_now.select("trace_id", F.col("agent").alias("to"), F.col("final").alias("x"))
        finals = cut(solved_now.unionByName(way.join(ends, ["trace_id", "to"]).select(*KEY, _at("fn", "x").alias("final"))))
        # an agent of a chain loses what its next one, now known, lacks
        of_next = finals.select("trace_id", F.col("agent").alias("next"), F.col("final").alias("f"))
        chain = rest & (F.col("open") == 1) & F.col("f").isNotNull()
        after = cut(raked.join(of_next, ["trace_id", "next"], "left").select(*KEY, "own_score", F.when(chain, F.col("lost") + _lost(F.col("f"))).otherwise(F.col("penalty")).alias("penalty")))
        release(state, way, solved_now, finals, now)
        state, before = after, waiting
        waiting = state.where("penalty IS NULL").count()
        if waiting == before:
            edges = _broken(state, edges)
    return state


def _broken(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with those marked that are taken as solved where nothing else can be: of agents on or between cycles, those from a higher id to a lower one."""
    stuck = cut(state.where("penalty IS NULL").select(*KEY))
    n = stuck.count()
    while True:  # take away from above what only leads to cycles
        inside = edges.join(stuck, KEY, "left_semi").join(stuck.withColumnRenamed("agent", "to"), ["trace_id", "to"], "left_semi")
        fewer = cut(inside.select("trace_id", F.col("to").alias("agent")).distinct())
        release(stuck)
        stuck, n, last = fewer, fewer.count(), n
        if n == last:
            break
    marks = stuck.withColumn("a", F.lit(True))
    both = edges.join(marks, KEY, "left").join(marks.select("trace_id", F.col("agent").alias("to"), F.col("a").alias("b")), ["trace_id", "to"], "left")
    on = F.coalesce(F.col("a") & F.col("b") & (F.col("to") < F.col("agent")), F.lit(False))
    return cut(both.select(*KEY, "to", (F.col("broken") | on).alias("broken")))
