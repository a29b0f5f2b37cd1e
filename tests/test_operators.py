"""Operators on small tables made by hand: the cases that tables of the driver do not hold."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell import catalog
from tracewell.operators import coverage, delegation, logs, penalties, scan, sessions

SPANS = "trace_id string, span_ord long, span_id string, parent_span_id string, agent_id string, agent_name string, model_used string, agent_framework string, operation string, span_kind string, finish_reason string"


def spans(spark, *rows):
    return spark.createDataFrame([("t", i + 1, s, p, a, None, m, None, op, None, None) for i, (s, p, a, m, op) in enumerate(rows)], SPANS)


def test_presence(spark):
    df = spans(spark, ("a", None, "x", "", ""), ("b", "a", None, "m", "chat"))
    pairs = [("operation", "non_empty"), ("model_used", "non_null"), ("nowhere", "present"), ("nowhere", "non_null"), ("trace_id", "non_null"), ("agent_id", "retention")]
    got = {(r["field"], r["check_type"]): r["present_count"] for r in coverage.coverage(df, pairs).collect()}
    assert got == {("operation", "non_empty"): 1, ("model_used", "non_null"): 2, ("nowhere", "present"): 2, ("nowhere", "non_null"): 0, ("trace_id", "non_null"): 0, ("agent_id", "retention"): 1}
    assert [r["coverage"] for r in coverage.coverage(df.limit(0), pairs).collect()] == [0.0] * 6


def test_graph_cases(spark):
    chain = spans(spark, ("a", None, "A", "m", "chat"), ("b", "a", "B", "m", "chat"), ("c", "b", "A", "m", "chat"), ("d", "lost", "C", "m", "human_review"), ("e", "f", "E", "m", "x"), ("f", "e", "F", "m", "x"), ("g", "g", "G", "m", "x"))
    depth = {r["span_id"]: r["depth"] for r in delegation.depths(chain).collect()}
    assert depth == {"a": 0, "b": 1, "c": 2, "d": 0, "e": -1, "f": -1, "g": -1}
    path = {r["span_id"]: r["delegation_path"] for r in delegation.paths(chain).collect()}
    assert path["c"] == ["B", "A"] and path["b"] == ["A", "B"] and path["d"] == ["C"] and set(path["e"]) == {"E", "F"}
    assert sorted(r["cycle"] for r in delegation.cycles(chain).collect()) == [["e", "f"], ["g"]]
    assert sorted(r["span_id"] for r in delegation.roots(chain).collect()) == ["a", "d"]
    assert {r["agent"] for r in delegation.unsupervised(delegation.agent_summary(chain)).collect()} == {"A", "B", "E", "F", "G"}


def test_paths_of_any_depth(spark):
    """A chain of 300 spans, each of an agent of its own, and a cycle of 200 with a tail."""
    chain = [(f"s{i}", f"s{i - 1}" if i else None, f"a{i}", "m", "x") for i in range(300)]
    ring = [(f"r{i}", f"r{(i - 1) % 200}", f"b{i}", "m", "x") for i in range(200)] + [("tail", "r0", "c", "m", "x")]
    path = {r["span_id"]: r["delegation_path"] for r in delegation.paths(spans(spark, *chain, *ring)).collect()}
    assert all(path[f"s{i}"] == [f"a{j}" for j in range(i + 1)] for i in range(300))
    assert path["tail"] == [f"b{i}" for i in range(1, 200)] + ["b0", "c"] and all(len(path[f"r{i}"]) == 200 for i in range(200))


def test_depths_and_cycles_of_any_length(spark):
    chain = [(f"s{i}", f"s{i - 1}" if i else None, "a", "m", "x") for i in range(200)]
    ring = [(f"r{i:03}", f"r{(i + 1) % 91:03}", "b", "m", "x") for i in range(91)] + [("tail", "r050", "c", "m", "x")]
    twice = [("d", "s3", "a", "m", "x"), ("d", "s150", "a", "m", "x")]  # one id, two parents
    df = spans(spark, *chain, *ring, *twice)
    depth = {r["span_id"]: r["depth"] for r in delegation.depths(df).collect()}
    assert all(depth[f"s{i}"] == i for i in range(200)) and depth["d"] == 151 and all(depth[f"r{i:03}"] == -1 for i in range(91)) and depth["tail"] == -1
    assert [r["cycle"] for r in delegation.cycles(df).collect()] == [[f"r{i:03}" for i in range(91)]]


def brute_penalties(own, to):
    """The same rule over dicts: solve what can be solved; of what is left, the highest id on or between cycles goes first."""
    lost, edges = {}, {(a, d) for a, ds in to.items() for d in ds if d in own}
    broken = set()
    while len(lost) < len(own):
        ready = [a for a in own if a not in lost and all(d in lost or (a, d) in broken for x, d in edges if x == a)]
        if not ready:
            stuck = set(own) - set(lost)
            while (fewer := {d for a, d in edges if a in stuck and d in stuck}) != stuck:
                stuck = fewer
            broken |= {(a, d) for a, d in edges if a in stuck and d in stuck and d < a}
            continue
        found = {}
        for a in ready:
            finals = [max(0.0, own[d] - (0.0 if (a, d) in broken else lost[d])) for x, d in edges if x == a]
            found[a] = sum(0.5 * (1 - f) for f in finals if f < 0.95)
        lost |= found
    return lost


@pytest.mark.parametrize("small", [penalties.SMALL, 6, 0])
def test_penalties_go_up(spark, small):
    rng = random.Random(5)
    agents, edges, want = [], [], {}
    for t in range(25 if small else 12):
        names = [f"g{i}" for i in range(rng.randrange(1, 8))]
        own = {a: rng.choice((0.0, 0.3, 0.6, 0.9, 0.97, 1.0)) for a in names}
        to = {a: {d for d in names if d != a and rng.random() < 0.3} for a in names}
        agents += [(f"t{t}", a, v) for a, v in own.items()]
        edges += [(f"t{t}", a, d) for a, ds in to.items() for d in ds] + [(f"t{t}", names[0], "unknown")]
        want |= {(f"t{t}", a): v for a, v in brute_penalties(own, to).items()}
    got = penalties.penalties(spark.createDataFrame(agents, "trace_id string, agent string, own_score double"), spark.createDataFrame(edges, "trace_id string, from_agent string, to_agent string"), small).collect()
    assert len(got) == len(want)
    for r in got:
        assert abs(r["penalty"] - want[r["trace_id"], r["agent"]]) < 1e-9 and abs(r["final_score"] - min(1, max(0, r["own_score"] - r["penalty"]))) < 1e-9


def test_penalties_of_no_agents(spark):
    none = spark.createDataFrame([], "trace_id string, agent string, own_score double")
    assert penalties.penalties(none, spark.createDataFrame([("t", "a", "b")], "trace_id string, from_agent string, to_agent string")).collect() == []


@pytest.mark.parametrize(("small", "length"), [(penalties.SMALL, 1000), (50, 1000)])
def test_penalties_of_a_long_chain_take_no_round_a_level(spark, small, length):
    """Two chains of single delegates below one agent with both, and a chain above it, against a plain pass from the end."""
    rng = random.Random(7)
    own = {f"{c}{i:05d}": rng.choice((0.2, 0.5, 0.96, 0.99, 1.0, 0.981)) for c in "abz" for i in range(length)} | {"m": 1.0}
    to = {f"{c}{i:05d}": [f"{c}{i + 1:05d}"] for c in "abz" for i in range(length - 1)} | {"m": ["a00000", "b00000"], f"z{length - 1:05d}": ["m"]}
    want = {}
    for a in [f"{c}{i:05d}" for c in "ab" for i in reversed(range(length))] + ["m"] + [f"z{i:05d}" for i in reversed(range(length))]:
        want[a] = sum(penalties.lost(max(0.0, own[d] - want[d])) for d in to.get(a, ()))
    began = time.time()
    agents = spark.createDataFrame([("t", a, v) for a, v in own.items()], "trace_id string, agent string, own_score double")
    edges = spark.createDataFrame([("t", a, d) for a, ds in to.items() for d in ds], "trace_id string, from_agent string, to_agent string")
    got = {r["agent"]: r["penalty"] for r in penalties.penalties(agents, edges, small).collect()}
    assert got.keys() == want.keys() and max(abs(got[a] - want[a]) for a in want) < 1e-9
    assert time.time() - began < (30 if small > 1000 else 120)


@given(st.lists(st.sampled_from([0.0, 0.3, 0.49, 0.5, 0.7, 0.951, 0.96, 0.98, 0.99, 1.0]), min_size=1, max_size=12), st.floats(0, 1))
@settings(max_examples=300, deadline=None)
def test_folded_functions_are_those_of_their_parts(owns, x):
    folded = penalties.single(owns[0])
    for own in owns[1:]:
        folded = penalties.chained(folded, penalties.single(own))
    y = x
    for own in reversed(owns):
        y = max(0.0, own - penalties.lost(y))
        if abs(y - penalties.SATISFIED) < 1e-9:
            return  # too near the step for either to be right
    start, slope, base = [p for p in folded if p[0] <= x][-1]
    if all(abs(x - p[0]) > 1e-9 for p in folded[1:]):
        assert abs(slope * x + base - y) < 1e-9


def test_log_lines(spark):
    head = "2024-01-01T00:00:0{}.000Z [{}] "
    lines = [
        (head + "Bash tool error (5ms): API error (attempt 1/2): x").format(1, "ERROR"), (head + 'MCP server "s": connected after 5ms').format(2, "ERROR"), (head + 'MCP server "s": connected after 5ms').format(3, "DEBUG"),
        (head + "Applying permission update: Adding 3 allow rule(s) to destination 'd'").format(4, "INFO"), (head + "Applying permission update: Adding 8 allow rule(s) to destination 'd'").format(0, "INFO"), "garbage",
        (head + "[STARTUP] MCP configs loaded in 6000ms").format(5, "WARN"),
    ]
    found = logs.events(spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "session_id string, line_no int, line string"))
    assert [r["kind"] for r in found.orderBy("line_no").collect()] == ["tool_error", "mcp_error", "mcp_connected", "permission", "permission", "startup"]
    one = logs.log_summary(found).first()
    assert (one["allow_rules"], one["boot_ms"], one["mcp_failures"], one["tool_errors"], round(one["duration_hours"] * 3600, 2)) == (8, 6000.0, 1, 1, 4.0)
    score = logs.health(logs.log_summary(found)).first()
    assert (score["tool_reliability"], score["startup_speed"], score["mcp_health"], score["grade"]) == (92, 50, 80, "A" if score["score"] >= 90 else "B")


@pytest.mark.parametrize("name", ["session_health", "friction", "log_summary", "health_rollup", "permission_insight"])
def test_log_queries_are_compiled(spark, name):
    """Generated code that the compiler refuses is an error here, not a silent change to interpreted expressions."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    try:
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
        spark.conf.unset("spark.sql.codegen.factoryMode")


def test_prompts_and_pairing(spark):
    prompts = spark.createDataFrame([("fix it",), ("no, instead do that?",), ("x" * 60,), ("y" * 250,)], "prompt string")
    one = sessions.prompt_stats(prompts).first()
    assert (one["prompts"], one["median_length"], one["short"], one["medium"], one["long"], one["questions"], one["commands"], one["corrections"]) == (4, 60, 2, 1, 1, 1, 1, 1)
    turns = spark.createDataFrame([(1, 1, "user"), (1, 2, "user"), (1, 3, "assistant"), (1, 4, "assistant"), (2, 1, "assistant")], "conv_id int, turn int, role string")
    assert sorted((r["conv_id"], r["turn"], r["user_turn"]) for r in sessions.turn_pairing(turns).collect() if r["user_turn"]) == [(1, 3, 2)]


def test_quotes_in_sources(spark):
    sources = spark.createDataFrame([(1, "Providers shall keep the logs that their high-\nrisk systems  make for ten years “at least”."), (2, None)], "source_id int, text string")
    quotes = spark.createDataFrame([(1, 'keep the logs that their highrisk systems make for ten years "at least"'), (2, "keep the logs that their systems make for ten whole years"), (3, "")], "quote_id int, quote string")
    assert {r["quote_id"]: r["finding"] for r in scan.quote_findings(quotes, sources).collect()} == {1: "ok", 2: "exact-quote-not-in-source", 3: "missing-exact-quote"}


def test_short_quotes_in_sources(spark):
    """The quotes of one to eight words that are in a source are found, also where their ends are parts of its words."""
    text = "providers shall keep the logs for ten years at least"
    sources = spark.createDataFrame([(1, text), (2, "other " + text), (3, "")], "source_id int, text string")
    inside = ["logs", "og", "the logs", "ders sh", "keep the logs", "eep the logs fo", "shall keep the logs for", "providers shall keep the logs for ten", text]
    quotes = spark.createDataFrame(list(enumerate([*inside, "log book", "keep logs", "keep the logs for a while at most", " "])), "quote_id int, quote string")
    got = {r["quote_id"]: (r["n_sources"], r["finding"]) for r in scan.quote_findings(quotes, sources).collect()}
    assert all(got[i] == (2, "ok") for i in range(len(inside))) and [got[len(inside) + i][1] for i in range(4)] == ["exact-quote-not-in-source"] * 3 + ["missing-exact-quote"]
    assert scan.quote_findings(quotes.limit(0), sources).count() == 0


def test_many_short_quotes_take_about_as_long_as_few(spark, monkeypatch):
    """The same findings as a plain search, in one block and in many, and 10,000 quotes within twice the time of 250."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 6)))
    texts = [(i, " ".join(word() for _ in range(400))) for i in range(60)]
    quotes = [(i, " ".join(word() for _ in range(rng.randrange(1, 3)))) for i in range(10_000)]
    sources = spark.createDataFrame(texts, "source_id int, text string").cache()
    want = {i: sum(q in t for _, t in texts) for i, q in quotes}

    def took(n):
        few, began = spark.createDataFrame(quotes[:n], "quote_id int, quote string"), time.time()
        got = {r["quote_id"]: r["n_sources"] for r in scan.quote_findings(few, sources).collect()}
        assert got == {i: want[i] for i in range(n)}
        return time.time() - began

    took(250)
    few, many = min(took(250) for _ in range(2)), took(10_000)
    assert many < 2 * few + 1
    monkeypatch.setattr(scan, "BLOCK", 100)
    took(450)


def test_quotes_of_all_lengths_in_one_pass_in_blocks_and_joined(spark, monkeypatch):
    """The same findings as a plain search by each way; as long as the quotes are few enough, sources are normalized and read once."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 4)))
    texts = [(i, " ".join(word() for _ in range(300))) for i in range(40)]

    def quote(i):
        if i % 3 == 0:
            return " ".join(word() for _ in range(rng.randrange(0, 5)))
        text = rng.choice(texts)[1]
        start = rng.randrange(len(text) - 90)
        return text[start : start + rng.randrange(1, 90)].strip()  # ends may be parts of words

    quotes = [(i, quote(i)) for i in range(400)]
    sources, asked = spark.createDataFrame(texts, "source_id int, text string"), spark.createDataFrame(quotes, "quote_id int, quote string")
    want = {i: sum(q in t for _, t in texts) if q else 0 for i, q in quotes}
    assert 0 in want.values() and max(want.values()) > 1

    def plan_of_right_findings():
        found = scan.quote_findings(asked, sources)
        assert {r["quote_id"]: r["n_sources"] for r in found.collect()} == want
        return found._jdf.queryExecution().optimizedPlan().toString()

    assert plan_of_right_findings().count("_nfkc(") == 1
    monkeypatch.setattr(scan, "BLOCK", 60)
    assert plan_of_right_findings().count("MapInArrow") == 7
    monkeypatch.setattr(scan, "PASSES", 3)
    assert "explode(" in plan_of_right_findings()


def test_provenance_codes(spark):
    files = spark.createDataFrame([("a", True, "law"), ("b", True, None), ("c", True, "gone"), ("d", False, "law")], "file string, verified boolean, source string")
    sources = spark.createDataFrame([("law", "Providers shall keep the logs.")], "source string, text string")
    rules = [("a", "r1", None, "shall keep"), ("a", "r2", None, None), ("a", "r3", None, "  "), ("a", "r4", "organizational", "made up"), ("b", "r5", None, "x"), ("d", "r6", None, "x"), ("a", "r7", None, "")]
    fields = [("r1", "f1", True, None, None), ("r1", "f2", False, None, None), ("r1", "f3", True, "structural", None), ("r1", "f4", True, "direct", ""), ("r1", "f5", False, "direct", "never said"), ("r1", "f6", True, "direct", "the logs"), ("r4", "f7", True, None, None)]
    got = scan.validate_quotes(files, spark.createDataFrame(rules, "file string, rule_id string, check_type string, exact_quote string"), spark.createDataFrame(fields, "rule_id string, field_path string, required boolean, legal_basis string, source_quote string"), sources)
    assert sorted((r["file"], r["rule_id"] or "", r["field_path"] or "", r["code"]) for r in got.collect()) == sorted([
        ("b", "", "", "verified-without-source"), ("c", "", "", "unknown-source"), ("a", "r2", "", "missing-exact-quote"), ("a", "r3", "", "empty-exact-quote"), ("a", "r4", "", "exact-quote-not-in-source"), ("a", "r7", "", "missing-exact-quote"), ("a", "r7", "", "empty-exact-quote"),
        ("a", "r1", "f1", "missing-legal-basis"), ("a", "r1", "f3", "required-without-direct-basis"), ("a", "r1", "f4", "direct-basis-missing-source-quote"), ("a", "r1", "f5", "source-quote-not-in-source"),
    ])


def test_imports_and_guides(spark):
    text = "from langchain_core.messages import x\nimport openairlines\nimport google.cloud.aiplatform.v1\n# model o3-mini-.\nx = 'https://a.b:80/c'\ny = 'http://localhost/x'"
    each = scan.lines(spark.createDataFrame([("f", text)], "path string, text string"))
    found = scan.match_modules(scan.imports(each), scan.dimension(spark, scan.IMPORTS))
    assert sorted((r["line_no"], r["library"]) for r in found.collect()) == [(1, "langchain"), (3, "google_genai")]
    assert [r["model"] for r in scan.model_refs(each).collect()] == ["o3-mini"]
    assert [(r["kind"], r["what"]) for r in scan.code_calls(each).collect()] == [("url", "a.b")]
    guide = "# Article 13\nwe inform users\n# Else\nwe inform users\n```mermaid\nclass A processor\n```\nrole depends on use; keep logs 6 months\n\n\n10 years"
    issues = scan.lint(scan.lines(spark.createDataFrame([("g", guide)], "path string, text string")))
    assert sorted((r["line_no"], r["rule_id"]) for r in issues.collect()) == [(2, "CG-001"), (6, "CG-007")]


def test_lines_with_several_hits(spark):
    text = """import os, openai as o, cohere; from anthropic import x
u, v = 'http://example.com/a', 'https://a.b/c'; w = "https://c.d:1/e"
a, b = client('s3'), resource("dynamodb")
m = ["gpt-4o", 'claude-3-opus', "gpt-4o"]  # or o3-mini"""
    each = scan.lines(spark.createDataFrame([("f", text)], "path string, text string"))
    found = scan.match_modules(scan.imports(each), scan.dimension(spark, scan.IMPORTS))
    assert sorted(r["library"] for r in found.collect()) == ["anthropic", "cohere", "openai"]
    assert sorted(r["module"] for r in scan.imports(each).collect()) == ["anthropic", "cohere", "openai", "os"]
    assert sorted(r["destination"] for r in scan.service_flows(found).collect()) == ["Anthropic API", "Cohere API", "OpenAI API"]
    assert sorted((r["line_no"], r["kind"], r["what"]) for r in scan.code_calls(each).collect()) == [(2, "url", "a.b"), (2, "url", "c.d"), (3, "aws", "dynamodb"), (3, "aws", "s3")]
    assert sorted((r["model"], r["n"]) for r in scan.model_refs(each).collect()) == [("claude-3-opus", 1), ("gpt-4o", 2), ("o3-mini", 1)]


def test_flows_have_one_row_a_service(spark):
    found = spark.createDataFrame([("b", 1, "openai"), ("a", 9, "openai"), ("c", 1, "faiss")], "path string, line_no int, library string").withColumn("module", F.col("library"))
    assert [tuple(r) for r in scan.service_flows(found).collect()] == [("a", "OpenAI API", "openai", "processor")]


def test_files_of_a_code_base(spark):
    """Kinds of files by name and folder, dependencies of packages, routes by path, and an empty code base."""
    from tracewell.operators import codescan

    names = ["a/App.test.tsx", "conftest.py", "src/Settings.PY", "pkg/contrib/x.py", "examples/x.py", "x.egg-info/y.py", "k8s/d.yml", "k8s/in/d.yml", "compose.dev.yaml", "setup.py", "package.json", "README"]
    text = {"setup.py": "# openai\ninstall = ['cohere', 'pinecone']\n", "package.json": '{"ai": "1",\n"left": "2"}'}
    files = spark.createDataFrame([(n, n, text.get(n, "")) for n in names] + [("null.py", "null.py", None)], "path string, inside string, text string")
    kinds = {r["path"]: (r["is_script"], r["is_test"], r["is_config"], r["usage_type"]) for r in codescan.classified(codescan.source_files(files)).collect()}
    plain, supported = (False, False, False, "uses"), (False, False, False, "supports")
    assert kinds == {"a/App.test.tsx": (True, True, False, "supports"), "conftest.py": (False, True, False, "supports"), "src/Settings.PY": (False, False, True, "uses"), "pkg/contrib/x.py": supported, "setup.py": plain, "null.py": plain}
    assert sorted((r["path"], r["line_no"], r["library"]) for r in codescan.dependencies(files).collect()) == [("package.json", 1, "vercel_ai"), ("setup.py", 2, "cohere")]
    assert sorted((r["path"], r["config_type"]) for r in codescan.deployments(files).collect()) == [("compose.dev.yaml", "compose"), ("k8s/d.yml", "kubernetes"), ("package.json", "package_json"), ("setup.py", "setup")]
    routes = spark.createDataFrame([("src/app/api/chat/route.ts",), ("api/index.ts",), ("a/api/b/api/c/d.ts",)], "p string").select(codescan.next_route(F.col("p"))).collect()
    assert [r[0] for r in routes] == ["/api/chat", "/api/[unknown]", "/api/c/d.ts"]
    for run in (codescan.ai_imports, codescan.endpoints, codescan.deployments, codescan.used_models):
        assert run(files.limit(0)).count() == 0


def test_only_traces_that_can_have_a_cycle_are_walked(spark, monkeypatch):
    """Parents that stand before their spans make none; spans without a place, at their own place or of several rows may."""
    rows = [("sound", i, f"s{i}", f"s{i // 2}" if i > 1 else None) for i in range(1, 40)] + [("orphan", 1, "a", "gone")]
    rows += [("ring", 1, "a", "c"), ("ring", 2, "b", "a"), ("ring", 3, "c", "b"), ("ring", 4, "d", "c"), ("self", 1, "a", "a"), ("none", None, "a", "b"), ("none", None, "b", "a")]
    rows += [("twice", 1, "a", "b"), ("twice", 2, "b", "a"), ("twice", 3, "a", "b"), ("back", 1, "a", "b"), ("back", 2, "b", None)]
    walked, depths = [], delegation.depths
    monkeypatch.setattr(delegation, "depths", lambda spans: walked.extend(r[0] for r in spans.select("trace_id").distinct().collect()) or depths(spans))
    got = delegation.cycles(spark.createDataFrame(rows, "trace_id string, span_ord long, span_id string, parent_span_id string")).collect()
    assert sorted((r["trace_id"], r["cycle"]) for r in got) == [("none", ["a", "b"]), ("ring", ["a", "c", "b"]), ("self", ["a"]), ("twice", ["a", "b"])]
    assert sorted(walked) == ["back", "none", "ring", "self", "twice"]
