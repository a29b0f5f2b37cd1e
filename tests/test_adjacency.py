"""Adjacency and paths of traces of several agents and of one."""

from tracewell.operators import delegation as dag

SPANS = "trace_id string, span_ord long, span_id string, parent_span_id string, agent_id string"


def test_lists_of_children_are_bounded(spark):
    rows = [("t", 1, "r", None, "a")] + [("t", n, f"s{n}", "r", "b") for n in range(2, 8)] + [("t", 8, "x", "nowhere", "b"), ("u", 1, "r", None, "a")]
    got = {(r.parent_id, r.part): r.children for r in dag.adjacency(spark.createDataFrame(rows, SPANS).repartition(3), part=4).collect()}
    assert got == {("r", 0): ["s2", "s3", "s4"], ("r", 1): ["s5", "s6", "s7"]}


def test_only_traces_of_several_agents_have_paths(spark):
    rows = [("two", 1, "r", None, "a"), ("two", 2, "c", "r", "b"), ("two", 2, "c", "r", "b"), ("one", 1, "r", None, "a"), ("one", 2, "c", "r", ""), ("none", 1, "r", None, None)]
    spans = spark.createDataFrame(rows, SPANS)
    assert [r.trace_id for r in dag.several_agents(spans).collect()] == ["two"]
    got = sorted((r.trace_id, r.span_id, r.delegation_path) for r in dag.enriched(spans).collect())
    assert got == [("none", "r", None), ("one", "c", None), ("one", "r", None), ("two", "c", ["a", "b"]), ("two", "c", ["a", "b"]), ("two", "r", ["a"])]
    assert dag.enriched(spans.limit(0)).count() == 0 and dag.adjacency(spans.limit(0)).count() == 0
