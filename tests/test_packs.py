"""Rule packs of YAML files: inheritance, one finding for each broken field, rules about several agents."""

import pyarrow as pa

from tracewell.sources import packs

PACK = """
regulation: Own
article: "7"
framework_nature: voluntary
verified_against_primary: true
requirements:
- {id: A, title: a, description: d}
- {id: B, title: b, description: d, regulation: not mine, article: "9", severity: best_practice, verified_against_primary: false, applies_to: [all, multi_agent_only], compliance_tier: quality,
   evidence_fields: [{field_path: x, description: y}, {field_path: z, description: y, required: false, check_type: non_empty, legal_basis: direct, source_quote: q}]}
- {id: C, title: "", severity: high, evidence_fields: [{field_path: x}, {}, 3]}
- just a text
- {id: D, title: d, description: d, applies_to: [minimal]}
"""


def test_a_folder_of_packs(spark, tmp_path):
    (tmp_path / "deep" / "node_modules").mkdir(parents=True)
    (tmp_path / "deep" / "node_modules" / "b.yaml").write_text(PACK)
    for name, text in (("a.yaml", "requirements: [\n"), ("c.yaml", ""), ("d.yaml", "regulation: x\n"), ("e.yaml", "requirements: 3\n"), ("f.txt", PACK), ("g.yaml", "requirements:\n- {id: E, title: t, description: !!python/object:os.system x}\n"), ("h.yaml", "requirements:\n- {id: F, title: 2024-01-01, description: [1]}\n")):
        (tmp_path / name).write_text(text)
    pack = packs.parsed(packs.pack_files(spark, str(tmp_path))).cache()
    rules = {r["rule_id"]: r for r in packs.requirements(pack).collect()}
    assert set(rules) == {"A", "B", "D", "F"}
    assert [(r["regulation"], r["article"], r["severity"], r["framework_nature"], r["verified"], r["applies_to"], r["tier"], r["rule_ord"]) for r in (rules["A"], rules["B"])] == [
        ("Own", "7", "mandatory", "voluntary", True, None, None, 0), ("Own", "9", "best_practice", "voluntary", False, ["all", "multi_agent_only"], "quality", 1),
    ]
    assert rules["F"]["regulation"] == "Unknown" and rules["F"]["title"] == "2024-01-01"
    assert [tuple(r)[1:7] for r in packs.evidence_fields(pack).orderBy("field_ord").collect()] == [(0, "x", "y", True, "non_null", None), (1, "z", "y", False, "non_empty", "direct")]
    wrong = sorted((r["file"].rsplit("/", 1)[1], -1 if r["rule_ord"] is None else r["rule_ord"], r["fault"]) for r in packs.findings(pack).collect())
    assert wrong == [
        ("a.yaml", -1, "YAML parse error"), ("b.yaml", 2, "evidence_field missing 'description'"), ("b.yaml", 2, "evidence_field missing 'description'"), ("b.yaml", 2, "evidence_field missing 'description'"), ("b.yaml", 2, "evidence_field missing 'field_path'"),
        ("b.yaml", 2, "evidence_field missing 'field_path'"), ("b.yaml", 2, "invalid severity 'high'"), ("b.yaml", 2, "missing required field 'description'"), ("b.yaml", 2, "missing required field 'title'"), ("b.yaml", 3, "not a mapping"),
        ("c.yaml", -1, "no 'requirements' key found"), ("d.yaml", -1, "no 'requirements' key found"), ("e.yaml", -1, "no 'requirements' key found"), ("g.yaml", -1, "YAML parse error"),
    ]
    both = spark.createDataFrame([(True,), (False,), (False,)], "is_multi_agent boolean")
    got = lambda traces: sorted((r["is_multi_agent"], r["rule_id"]) for r in packs.applicable_to(packs.requirements(pack), traces).collect())
    assert got(both) == [(False, "A"), (False, "F"), (True, "A"), (True, "B"), (True, "F")] and got(both.where("false")) == []


def test_rules_go_on_by_some_files_at_a_time():
    """A task never holds the rules of all files of a batch, whose text is more than it parses at once; none is lost."""
    text = "requirements:\n" + "".join(f"- {{id: I{i}, title: t, description: d}}\n" for i in range(400))
    files = pa.RecordBatch.from_arrays([pa.array([f"f{i}" for i in range(200)]), pa.array([text, None] * 100)], ["path", "text"])
    out = list(packs._parsed(iter([files])))
    assert max(b.num_rows for b in out) <= 400 * (packs.AT_ONCE // len(text) + 1) + 200 and len(out) > 1
    assert [r["file"] for b in out for r in b.to_pylist()] == [f for i in range(200) for f in [f"f{i}"] * (1 if i % 2 else 400)]
    assert list(packs._parsed(iter([files.slice(0, 0)]))) == []
