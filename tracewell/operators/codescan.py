"""Scans of whole code bases: kinds of files, imports of scripts, addresses of providers, endpoints, metrics, deployment and dependency files.

Input are files (path, inside, text): path names a file, inside is its path from the root of its code base. A line carries the one after it, so that
no window over the lines of a file is needed; nothing is shuffled but the grouping by file at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan

# Folders that are not searched, and kinds of source files.
SKIPPED = ("node_modules", ".venv", "venv", "__pycache__", ".git", "dist", "build", ".next", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "env", ".eggs", "coverage", ".coverage", "htmlcov", "fixtures", "test_data", "testdata", "sample_codebase", "examples", "samples", "__fixtures__", "mock_data", "mocks")
PYTHON = r"[^/]\.py$"
SCRIPT = r"[^/]\.(js|jsx|ts|tsx|mjs|cjs)$"
# Names of tests, configurations and optional integrations.
TEST_FOLDERS = ("test", "tests", "testing", "test_utils", "fixtures", "mocks", "mock", "stubs", "fakes", "conftest")
TEST_NAME = r"^(test_|tests_|conftest)|(_test\.py|_tests\.py|_spec\.py|_spec\.ts|_spec\.js|\.test\.ts|\.test\.js|\.test\.tsx|\.spec\.ts|\.spec\.js)$"
CONFIGS = ("config.py", "settings.py", "constants.py", "defaults.py", "model_prices.py", "model_map.py", "model_config.py", "model_list.py", "supported_models.py", "cost_map.py")
SUPPORT_FOLDERS = ("integrations", "integration", "plugins", "plugin", "extensions", "extension", "contrib", "contrib_modules", "connectors", "connector", "providers", "provider", "adapters", "adapter", "backends", "backend", "examples", "example", "samples", "sample", "cookbook", "cookbooks", "recipes", "demo", "demos", "optional", "extras", "third_party")
# Packages of scripts by library, in order of precedence.
SCRIPT_PACKAGES = {
    "anthropic": ["@anthropic-ai/sdk", "anthropic"], "openai": ["openai"], "google_genai": ["@google/generative-ai", "@google-cloud/aiplatform"], "langchain": ["langchain", "@langchain/core", "@langchain/openai", "@langchain/anthropic"],
    "huggingface": ["@huggingface/inference", "@huggingface/transformers"], "cohere": ["cohere-ai"], "vercel_ai": ["ai", "@ai-sdk/anthropic", "@ai-sdk/openai", "@ai-sdk/google"],
}
SCRIPT_STORES = {"pinecone": ["@pinecone-database/pinecone"], "weaviate": ["weaviate-ts-client", "weaviate-client"], "qdrant": ["@qdrant/js-client-rest"], "chromadb": ["chromadb"], "supabase_vector": ["@supabase/supabase-js"]}
SCRIPT_IMPORTS = (r"import\s+.*?\s+from\s+['\"](.+?)['\"]", r"import\s+['\"](.+?)['\"]", r"import\s*\(\s*['\"](.+?)['\"]\s*\)", r"require\s*\(\s*['\"](.+?)['\"]\s*\)")
# Hosts of providers, metrics, routes.
HOSTS = {"anthropic": r"api\.anthropic\.com", "openai": r"api\.openai\.com", "google_genai": r"generativelanguage\.googleapis\.com", "cohere": r"api\.cohere\.ai", "mistral": r"api\.mistral\.ai", "huggingface": r"api-inference\.huggingface\.co"}
METRICS = {
    "accuracy_score": "accuracy_score", "f1_score": "f1_score", "precision_score": "precision_score", "recall_score": "recall_score", "roc_auc_score": "roc_auc_score", "mean_squared_error": "mean_squared_error", "mean_absolute_error": "mean_absolute_error",
    "classification_report": "classification_report", "confusion_matrix": "confusion_matrix", "evaluate": r"evaluate\s*\(", "bleu_score": "bleu_score", "rouge_score": "rouge_score", "perplexity": "perplexity",
}
ROUTES = {"fastapi": r"@(?:app|router)\.(get|post|put|delete|patch)\s*\(", "flask": r"@(?:app|blueprint)\.route\s*\("}
SCRIPT_ROUTE = r"(?:app|router)\.(get|post|put|delete|patch|all)\s*\("
ROUTE = r"['\"](/[^'\"]*?)['\"]"
UNKNOWN = "[unknown]"
# Deployment files, and files of dependencies, which only count where they name a package.
DEPLOYMENTS = {"dockerfile": r"^Dockerfile(\.[^/]*)?$", "compose": r"^(docker-compose|compose)[^/]*\.ya?ml$", "kubernetes": r"^(k8s|kubernetes)/[^/]*\.ya?ml$", "terraform": r"^[^/]*\.tf$"}
DECLARED = {"requirements": r"^(requirements\.txt|requirements/base\.txt|requirements/prod\.txt)$", "pyproject": r"^pyproject\.toml$", "setup": r"^setup\.(py|cfg)$", "package_json": r"^package\.json$"}
MOST_MODELS = 10  # a file with more references to models is a table of them, not a user


def _packages(*dims: dict[str, list[str]]) -> list[tuple[str, str]]:
    return [(package, library) for dim in dims for library, packages in dim.items() for package in packages]


ANY_PACKAGE = "|".join(re.sub(r"([.])", r"\\\1", p) for p, _ in _packages(scan.IMPORTS, scan.VECTOR_STORES, SCRIPT_PACKAGES, SCRIPT_STORES))


def classified(files: DataFrame) -> DataFrame:
    """files with is_test, is_config, usage_type: what tests and optional integrations import is only supported, all else used."""
    parts = F.split("inside", "/")
    name = F.lower(F.element_at(parts, -1))
    within = lambda folders: F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.lower(p).isin(*folders))
    out = files.withColumns({"is_test": name.rlike(TEST_NAME) | within(TEST_FOLDERS), "is_config": name.isin(*CONFIGS)})
    return out.withColumn("usage_type", F.when(F.col("is_test") | within(SUPPORT_FOLDERS), "supports").otherwise("uses"))


def source_files(files: DataFrame) -> DataFrame:
    """Files of Python and of scripts outside skipped folders, with is_script."""
    parts = F.split("inside", "/")
    skipped = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*SKIPPED) | p.endswith(".egg-info"))
    low = F.lower("inside")
    return files.where((low.rlike(PYTHON) | low.rlike(SCRIPT)) & ~skipped).withColumn("is_script", low.rlike(SCRIPT))


def lines(files: DataFrame, *more: str) -> DataFrame:
    """path, more, line_no (from 1), line, following: the next line, null after the last."""
    every = F.split("text", "\n", -1)
    pairs = F.arrays_zip(every.alias("line"), F.slice(every, F.lit(2), F.size(every)).alias("following"))
    each = files.select("path", *more, F.posexplode(pairs).alias("i", "l"))
    return each.select("path", *more, (F.col("i") + 1).alias("line_no"), F.col("l.line").alias("line"), F.col("l.following").alias("following"))


def _said(patterns: Iterable[tuple[str, str]]) -> Column:
    """The names whose pattern is in the line, in order, with their number."""
    return F.filter(F.array(*(F.when(F.col("line").rlike(p), F.struct(F.lit(i).alias("i"), F.lit(n).alias("name"))) for i, (n, p) in enumerate(patterns))), lambda x: x.isNotNull())


def metrics(each_line: DataFrame) -> DataFrame:
    """path, metrics: the distinct metrics of a file in the order in which they are first seen."""
    seen = each_line.select("path", "line_no", F.explode(_said(METRICS.items())).alias("m")).groupBy("path", F.col("m.name").alias("name")).agg(F.min(F.struct("line_no", "m.i")).alias("at"))
    return seen.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("metrics"))


def provider_addresses(each_line: DataFrame) -> DataFrame:
    """path, library, line_no: the first line of a file with the address of each provider."""
    return each_line.select("path", "line_no", F.explode(_said(HOSTS.items())).alias("h")).groupBy("path", F.col("h.name").alias("library")).agg(F.min("line_no").alias("line_no"))


def script_imports(each_line: DataFrame) -> DataFrame:
    """path, line_no, package, library, is_store: every import of a known package or of a path within it, as often as it stands there."""
    spark = each_line.sparkSession
    known = [(i, p, lib, i >= len(_packages(SCRIPT_PACKAGES))) for i, (p, lib) in enumerate(_packages(SCRIPT_PACKAGES, SCRIPT_STORES))]
    dim = spark.createDataFrame(known, "rank int, prefix string, library string, is_store boolean")
    found = each_line.select("path", "line_no", F.posexplode(F.concat(*(F.regexp_extract_all("line", F.lit(p), 1) for p in SCRIPT_IMPORTS))).alias("n", "package"))
    parts = F.split("package", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    hits = found.withColumn("prefix", F.explode(prefixes)).join(F.broadcast(dim), "prefix")
    best = hits.groupBy("path", "line_no", "n", "package").agg(F.min_by(F.struct("library", "is_store"), F.struct(F.col("prefix") != F.col("package"), "rank")).alias("b"))
    return best.select("path", "line_no", "package", "b.library", "b.is_store")


def ai_imports(files: DataFrame) -> DataFrame:
    """path, library, line_no, usage_type: one row a library and file over modules, packages, addresses and declared dependencies; a used one before a supported one, then the first."""
    sources = classified(source_files(files))
    python, script = lines(sources.where(~F.col("is_script"))), lines(sources.where("is_script"))
    modules = scan.match_modules(scan.imports(python), scan.dimension(files.sparkSession, scan.IMPORTS))
    kinds = [(modules, 0, 0), (provider_addresses(python), 1, 1), (script_imports(script).where(~F.col("is_store")), 0, 0), (provider_addresses(script), 0, 1)]
    found = None
    for rows, first, then in kinds:
        rows = rows.select("path", "library", "line_no", F.lit(first).alias("first"), F.lit(then).alias("then"))
        found = rows if found is None else found.unionByName(rows)
    found = found.join(sources.select("path", "usage_type"), "path")
    declared = dependencies(files).select("path", "library", "line_no", F.lit(2).alias("first"), F.lit(0).alias("then"), F.lit("uses").alias("usage_type"))
    order = F.struct(F.col("usage_type") != "uses", "first", "line_no", "then")
    best = found.unionByName(declared).groupBy("path", "library").agg(F.min_by(F.struct("line_no", "usage_type"), order).alias("b"))
    return best.select("path", "library", "b.line_no", "b.usage_type")


def next_route(path: Column) -> Column:
    """Route that a path names behind its last /api/, without route and index files."""
    kept = F.filter(F.split(F.element_at(F.split(path, "/api/"), -1), "/"), lambda s: ~s.startswith("route.") & ~s.startswith("index."))
    return F.when(path.contains("/api/"), F.concat(F.lit("/api/"), F.regexp_replace(F.array_join(kept, "/"), "/+$", ""))).otherwise("/api/" + UNKNOWN)


def endpoints(files: DataFrame) -> DataFrame:
    """path, framework, route, line_no: routes of files that import a library; a Python route may stand in the line after."""
    sources = source_files(files)
    python, script = lines(sources.where(~F.col("is_script"))), lines(sources.where("is_script"))
    modules = scan.match_modules(scan.imports(python), scan.dimension(files.sparkSession, scan.IMPORTS)).select("path").distinct()
    scripts = script_imports(script).where(~F.col("is_store")).select("path").union(provider_addresses(script).select("path")).distinct()
    route = lambda line: F.nullif(F.regexp_extract(line, ROUTE, 1), F.lit(""))
    of_python = python.join(modules, "path", "left_semi").select("path", "line_no", F.coalesce(route("line"), route("following"), F.lit(UNKNOWN)).alias("route"), F.explode(_said(ROUTES.items())).alias("f"))
    of_script = script.where(F.col("line").rlike(SCRIPT_ROUTE)).join(scripts, "path", "left_semi").select("path", F.lit("express").alias("framework"), F.coalesce(route("line"), F.lit(UNKNOWN)).alias("route"), "line_no")
    by_path = sources.where(F.col("is_script") & F.col("path").contains("/api/")).join(scripts, "path", "left_semi").select("path", F.lit("nextjs").alias("framework"), next_route(F.col("path")).alias("route"), F.lit(1).alias("line_no"))
    return of_python.select("path", F.col("f.name").alias("framework"), "route", "line_no").unionByName(of_script).unionByName(by_path)


def deployments(files: DataFrame) -> DataFrame:
    """path, config_type, contains_ai: deployment files at the root, and files of dependencies that name a known package anywhere."""
    named = F.coalesce(F.col("text").rlike(ANY_PACKAGE), F.lit(False))
    inside = F.col("inside")
    kinds = [F.when(inside.rlike(p), F.lit(n)) for n, p in DEPLOYMENTS.items()] + [F.when(inside.rlike(p) & named, F.lit(n)) for n, p in DECLARED.items()]
    return files.select("path", F.explode(F.filter(F.array(*kinds), lambda k: k.isNotNull())).alias("config_type"), named.alias("contains_ai"))


def dependencies(files: DataFrame) -> DataFrame:
    """path, line_no, library, package: the first known package in each line of a file of dependencies; comments and stores of vectors are left out."""
    first = lambda hits: F.coalesce(*(F.when(hit, F.struct(F.lit(lib).alias("library"), F.lit(p).alias("package"))) for p, lib, hit in hits))
    low = F.lower(F.trim("line"))
    is_python = F.col("inside").rlike(f"{DECLARED['requirements']}|{DECLARED['pyproject']}|{DECLARED['setup']}")
    each = lines(files.where(is_python | F.col("inside").rlike(DECLARED["package_json"])), "inside")
    of_python = F.when((low != "") & ~low.rlike("^[#;]"), first([(p, lib, low.contains(p)) for p, lib in _packages(scan.IMPORTS)]))
    of_script = first([(p, lib, F.col("line").contains(f'"{p}"') | F.col("line").contains(f"'{p}'")) for p, lib in _packages(SCRIPT_PACKAGES)])
    return each.withColumn("d", F.when(is_python, of_python).otherwise(of_script)).where("d is not null").select("path", "line_no", "d.library", "d.package")


def used_models(files: DataFrame) -> DataFrame:
    """model, path, line_no, n of the models that code uses: not of tests, configurations and files with more than ten references."""
    sources = classified(source_files(files)).where(~F.col("is_test") & ~F.col("is_config"))
    hits = scan.model_hits(lines(sources))
    few = hits.groupBy("path").count().where(F.col("count") <= MOST_MODELS).select("path")
    return scan.distinct_models(hits.join(few, "path", "left_semi"))
