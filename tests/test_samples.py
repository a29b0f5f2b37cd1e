"""Samples of fields and texts of gaps, on small tables."""

import random

from tracewell.operators import coverage as cov


def test_first_samples_are_those_of_a_sort(spark):
    rng = random.Random(5)
    rows = [(f"t{rng.randrange(40)}", n, rng.choice([None, "", "x", "y" * 90, f"v{rng.randrange(9)}"]), [str(rng.randrange(3)) for _ in range(rng.randrange(5))], {"a": n}) for n in range(3000)]
    rng.shuffle(rows)
    spans = spark.createDataFrame(rows, "trace_id string, span_ord long, model_used string, finish_reasons array<string>, more map<string, long>").repartition(7)
    got = {r.field: r.samples for r in cov.coverage_samples(spans, ["model_used", "finish_reasons", "temperature"]).collect()}
    short = lambda v: v if len(v) <= 80 else v[:80] + "..."
    want = list(dict.fromkeys(short(r[2]) for r in sorted(rows, key=lambda r: r[:2]) if r[2] is not None))[:5]
    assert got["model_used"] == want
    lists = list(dict.fromkeys("[" + ",".join(f'"{v}"' for v in r[3][:3]) + "]" for r in sorted(rows, key=lambda r: r[:2])))[:5]
    assert got["finish_reasons"] == lists and got["temperature"] == []
    nested = {(r.field, r.check_type): r for r in cov.path_samples(spans, [("more.a", "non_null"), ("model_used", "non_empty"), ("none", "non_null")], ["trace_id", "span_ord"]).collect()}
    assert nested["more.a", "non_null"].samples == [str(r[1]) for r in sorted(rows, key=lambda r: r[:2])[:5]]
    assert nested["model_used", "non_empty"].samples == [short(r[2]) for r in sorted(rows, key=lambda r: r[:2]) if r[2]][:5]  # repeats stay
    assert nested["none", "non_null"].samples == [] and nested["none", "non_null"].population == 0


def test_repeated_rows_and_empty_tables(spark):
    schema = "trace_id string, span_ord long, model_used string"
    same = spark.createDataFrame([("t", 1, "m")] * 4 + [(None, None, "n")], schema)
    assert cov.coverage_samples(same, ["model_used"]).first().samples == ["n", "m"]  # no place comes first
    assert cov.path_samples(same, [("model_used", "non_null")], ["trace_id", "span_ord"]).first().samples == ["n", "m", "m", "m", "m"]
    assert cov.coverage_samples(spark.createDataFrame([], schema), ["model_used"]).first().samples == []


def test_texts_of_gaps(spark):
    rows = [("R-1", "Rules", 0, "spans[].provider", "d", 0.0, 0, 9), ("R-2", "Rules", 0, "spans[].seed", "d", 33.3, 3, 9)]
    gaps = spark.createDataFrame(rows, "rule_id string, regulation string, field_ord int, field_path string, description string, coverage_pct double, present_count long, population long")
    one, two = sorted(cov.gap_advice(gaps).collect(), key=lambda r: r.rule_id)
    assert one.impact == "Rules R-1 — your traces contain zero values for `spans[].provider`." and one.recommendation == cov.ADVICE["provider"]
    assert two.impact == "Rules R-2 — only 3/9 spans have `spans[].seed`." and two.recommendation == "Add `spans[].seed` to your trace exports. Currently 3/9 spans include this field."


def test_report_of_rules_with_and_without_gaps(spark):
    scored = spark.createDataFrame([("R-2", "Rules", "mandatory", 0.5, "partial"), ("R-1", "Rules", "mandatory", 1.0, "satisfied"), ("S-1", "Others", "mandatory", 0.0, "missing")], "rule_id string, regulation string, severity string, score double, status string")
    rows = [("R-2", "Rules", 1, "spans[].seed", "d", 0.0, 0, 9), ("R-2", "Rules", 0, "spans[].provider", "d", 33.3, 3, 9)]
    gaps = spark.createDataFrame(rows, "rule_id string, regulation string, field_ord int, field_path string, description string, coverage_pct double, present_count long, population long")
    got = {r.regulation: r for r in cov.report(scored, gaps).collect()}
    assert (got["Rules"].overall_score, got["Rules"].n_satisfied, got["Rules"].n_partial, got["Rules"].n_missing, got["Others"].n_missing) == (0.75, 1, 1, 0, 1)
    assert [(q.rule_id, [g.field_path for g in q.gaps]) for q in got["Rules"].requirements] == [("R-1", []), ("R-2", ["spans[].provider", "spans[].seed"])]
    assert cov.report(scored.limit(0), gaps.limit(0)).count() == 0
