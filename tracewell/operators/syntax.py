"""Source files by their syntax trees: imports wherever they stand and however they are broken over lines, texts that name models, and the services that a
code base talks to, with the flows of data that this means.

A table function parses a file a row, in the task that has the row. A file that does not parse is marked, and its imports are what patterns find in its lines.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scan
from .codescan import PYTHON, SCRIPT

# Libraries by what they are for. Databases: what is stored in, library, modules. Cloud services: provider, service, modules; of a module that
# stands in several, the last counts.
HTTP_CLIENTS = {"requests": ["requests"], "httpx": ["httpx"], "aiohttp": ["aiohttp"], "urllib3": ["urllib3"]}
DATABASES = (
    ("postgresql", "psycopg2", ["psycopg2", "psycopg", "asyncpg"]), ("postgresql", "sqlalchemy", ["sqlalchemy"]), ("mysql", "pymysql", ["pymysql", "mysql.connector", "aiomysql"]), ("mongodb", "pymongo", ["pymongo", "motor"]),
    ("redis", "redis", ["redis", "aioredis"]), ("sqlite", "sqlite3", ["sqlite3", "aiosqlite"]), ("elasticsearch", "elasticsearch", ["elasticsearch"]),
)
CLOUD = (
    ("aws", "s3", ["boto3"]), ("aws", "bedrock", ["boto3"]), ("aws", "sagemaker", ["sagemaker"]), ("aws", "lambda", ["boto3"]), ("gcp", "vertex_ai", ["vertexai", "google.cloud.aiplatform"]), ("gcp", "cloud_storage", ["google.cloud.storage"]),
    ("gcp", "bigquery", ["google.cloud.bigquery"]), ("gcp", "firestore", ["google.cloud.firestore"]), ("azure", "openai", ["openai"]), ("azure", "blob_storage", ["azure.storage.blob"]), ("azure", "cosmos_db", ["azure.cosmos"]),
)
SCRIPT_HTTP_CLIENTS = {"axios": ["axios"], "node-fetch": ["node-fetch"], "got": ["got"], "ky": ["ky"], "undici": ["undici"]}
SCRIPT_DATABASES = (("postgresql", "pg", ["pg", "@prisma/client", "drizzle-orm", "knex"]), ("mongodb", "mongoose", ["mongoose", "mongodb"]), ("redis", "ioredis", ["ioredis", "redis"]), ("sqlite", "better-sqlite3", ["better-sqlite3", "sql.js"]))
SCRIPT_IMPORT = r"(?:import\s+.*?\s+from\s+|require\s*\(\s*)['\"](.+?)['\"]"
# What a service means for data protection: name, type, role, note, type of data, purpose, whether personal, jurisdiction, safeguards needed.
SERVICES = {
    "anthropic": ("Anthropic API", "cloud_api", "processor", "typically processor for customer data; verify per Anthropic DPA", "prompts", "inference", "likely", "US", True),
    "openai": ("OpenAI API", "cloud_api", "processor", "typically processor for customer data; verify per OpenAI DPA", "prompts", "inference", "likely", "US", True),
    "google_genai": ("Google Generative AI", "cloud_api", "processor", "typically processor for customer data; verify per Google Cloud DPA", "prompts", "inference", "likely", "US", True),
    "cohere": ("Cohere API", "cloud_api", "processor", "typically processor for customer data; verify per Cohere DPA", "prompts", "inference", "likely", "CA", True),
    "huggingface": ("HuggingFace", "cloud_api", "processor", "role depends on usage: Inference API is processor; local models have no GDPR transfer", "model_data", "inference", "unknown", "US", True),
    "pinecone": ("Pinecone", "cloud_api", "processor", "typically processor; verify per Pinecone DPA", "embeddings", "storage", "likely", "US", True),
    "weaviate": ("Weaviate", "managed", "processor", "processor if using Weaviate Cloud; controller if self-hosted", "embeddings", "storage", "likely", "NL", False),
    "qdrant": ("Qdrant", "managed", "processor", "processor if using Qdrant Cloud; controller if self-hosted", "embeddings", "storage", "likely", "DE", False),
    "chromadb": ("ChromaDB", "self_hosted", "controller", "", "embeddings", "storage", "likely", "self_hosted", False),
    "faiss": ("FAISS", "self_hosted", "controller", "", "embeddings", "storage", "unknown", "self_hosted", False),
}
DATABASE_NOTE = "your organization is typically the controller when operating this database; verify per your data processing agreements"
CLOUD_NOTE = "the cloud service operator typically acts as processor; verify per provider's DPA"

_ITEM = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("line_no", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
#: Which flows come first: services of models, vector stores, databases, cloud services.
ORDER = ("ai_provider", "vector_db", "database", "cloud")


class _Syntax:
    """n, line_no, kind, value of a Python file: `import` with the module, `text` with a string, in the order of a walk through the tree by levels; one row
    `broken` if the file does not parse."""

    def eval(self, source: str) -> Iterator[tuple[int, int, str, str]]:
        try:
            tree = ast.parse(source or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            yield 0, 0, "broken", ""
            return
        n = 0
        for node in ast.walk(tree):
            for kind, value in self.items(node):
                yield n, node.lineno, kind, value
                n += 1

    @staticmethod
    def items(node: ast.AST) -> list[tuple[str, str]]:
        if isinstance(node, ast.Import):
            return [("import", alias.name) for alias in node.names]
        if isinstance(node, ast.ImportFrom) and node.module:
            return [("import", node.module)]
        # a surrogate by itself, as "\ud800" gives, is no text that a table can hold
        return [("text", node.value.encode("utf-8", "replace").decode())] if isinstance(node, ast.Constant) and isinstance(node.value, str) else []


def python_items(files: DataFrame) -> DataFrame:
    """path, n, line_no, kind, value of the Python files among files (path, text); null texts are empty files."""
    syntax = F.udtf(_Syntax, returnType=_ITEM)
    python = files.where(F.lower("path").rlike(PYTHON)).select("path", "text")
    return python.lateralJoin(syntax(F.col("text").outer())).select("path", "n", "line_no", "kind", "value")


def imports(files: DataFrame) -> DataFrame:
    """path, n, line_no, module, parsed: every module that a Python file imports; of a file that does not parse, those of its lines, with parsed false."""
    items = python_items(files)
    sound = items.where("kind = 'import'").select("path", "n", "line_no", F.col("value").alias("module"), F.lit(True).alias("parsed"))
    broken = files.join(items.where("kind = 'broken'").select("path").distinct(), "path", "left_semi")
    guessed = scan.imports(scan.lines(broken)).select("path", F.col("line_no").alias("n"), "line_no", "module", F.lit(False).alias("parsed"))
    return sound.unionByName(guessed)


def model_refs(files: DataFrame) -> DataFrame:
    """path, line_no, model: the model that a text of a Python file names, one for each text, also where it is broken over lines."""
    hit = F.coalesce(*(F.nullif(F.regexp_extract("value", f"({p})", 1), F.lit("")) for p in scan.MODELS))
    return python_items(files).where("kind = 'text'").select("path", "line_no", hit.alias("model")).where(F.col("model").isNotNull())


def _rows(files: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(files.sparkSession.createDataFrame(rows, schema))


def _matched(found: DataFrame, dim: DataFrame, separator: str) -> DataFrame:
    """found with kind, what and library of the first row of dim, by rank, whose module is the imported one or what stands before a separator in it."""
    parts = F.split("module", "\\." if separator == "." else separator)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))
    hits = found.withColumn("prefix", F.explode(prefixes)).join(dim, "prefix")
    return hits.groupBy("path", "stage", "n", "line_no", "module").agg(F.min_by(F.struct("kind", "what", "library"), "rank").alias("m")).select("path", "stage", "n", "line_no", "module", "m.*")


def usages(files: DataFrame) -> DataFrame:
    """path, stage, n, line_no, module, kind, what, library: what a code base imports or calls of model services, vector stores, HTTP clients, databases and clouds.

    Files (path, text); of Python files that do not parse nothing counts but their calls of cloud services. stage and n order what a file has."""
    schema = "rank int, prefix string, kind string, what string, library string"
    listed = [(lib, m) for lib, ms in scan.IMPORTS.items() for m in ms]
    ai = [(m, "ai_provider", lib, lib) for lib, m in listed] + [(m, "vector_db", lib, lib) for lib, ms in scan.VECTOR_STORES.items() for m in ms]
    cloud = {m: (m, "cloud", f"{provider}:{service}", m) for provider, service, ms in CLOUD for m in ms}
    rest = [(m, "http", lib, lib) for lib, ms in HTTP_CLIENTS.items() for m in ms] + [(m, "database", kind, lib) for kind, lib, ms in DATABASES for m in ms] + list(cloud.values())
    ranked = lambda rows: _rows(files, [(i, *r) for i, r in enumerate(rows)], schema)
    python = imports(files).where("parsed").select("path", F.lit(0).alias("stage"), "n", "line_no", "module")
    each = scan.lines(files.where(F.lower("path").rlike(SCRIPT)))
    script = each.select("path", F.lit(0).alias("stage"), F.col("line_no").alias("n"), "line_no", F.explode(F.regexp_extract_all("line", F.lit(SCRIPT_IMPORT), 1)).alias("module"))
    exact = ranked([(m, "http", lib, lib) for lib, ms in SCRIPT_HTTP_CLIENTS.items() for m in ms])
    of_clients = script.join(exact, script["module"] == exact["prefix"]).select(*script.columns, "kind", "what", "library")
    databases = ranked([(m, "database", kind, lib) for kind, lib, ms in SCRIPT_DATABASES for m in ms])
    calls = scan.code_calls(scan.lines(files.where(F.lower("path").rlike(PYTHON) | F.lower("path").rlike(SCRIPT)))).where("kind = 'aws'")
    of_calls = calls.select("path", F.lit(1).alias("stage"), F.col("line_no").alias("n"), "line_no", F.lit("boto3").alias("module"), F.lit("cloud").alias("kind"), F.concat(F.lit("aws:"), "what").alias("what"), F.lit("boto3").alias("library"))
    return _matched(python, ranked(ai), ".").unionByName(_matched(python, ranked(rest), ".")).unionByName(of_clients).unionByName(_matched(script, databases, "/")).unionByName(of_calls)


def data_flows(used: DataFrame) -> DataFrame:
    """flow_ord, category, destination, service_type, data_type, purpose, role, note, pii, jurisdiction, needs_safeguards, path, line_no, module of usages, one for each
    service, by the first place that uses it. HTTP clients give no flow, since no import tells whom they call."""
    known = _rows(used, [(k, *v) for k, v in SERVICES.items()], "what string, destination string, service_type string, role string, note string, data_type string, purpose string, pii string, jurisdiction string, needs_safeguards boolean")
    place = F.struct("path", "stage", "n", "line_no", "module")
    first = used.where(F.col("kind").isin(*ORDER)).groupBy("kind", "what", F.when(F.col("kind") == "database", F.col("library")).alias("library")).agg(F.min(place).alias("at"))
    stored = F.concat(F.initcap("what"), F.lit(" ("), "library", F.lit(")"))
    clouds = F.concat(F.upper(F.split_part("what", F.lit(":"), F.lit(1))), F.lit(" "), F.split_part("what", F.lit(":"), F.lit(2)))
    is_database = F.col("kind") == "database"
    own = first.where(F.col("kind").isin("database", "cloud")).select(
        "kind", "at", F.when(is_database, stored).otherwise(clouds).alias("destination"), F.when(is_database, "self_hosted").otherwise("cloud_api").alias("service_type"), F.when(is_database, "controller").otherwise("processor").alias("role"),
        F.when(is_database, DATABASE_NOTE).otherwise(CLOUD_NOTE).alias("note"), F.lit("user_data").alias("data_type"), F.lit("storage").alias("purpose"), F.when(is_database, "likely").otherwise("unknown").alias("pii"), F.lit("").alias("jurisdiction"), F.lit(False).alias("needs_safeguards"),
    )
    named = first.where(F.col("kind").isin("ai_provider", "vector_db")).join(known, "what").select(*own.columns)
    rank: Column = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    out = named.unionByName(own).select(F.struct(rank.alias("rank"), "at.path", "at.stage", "at.n", "destination").alias("flow_ord"), F.col("kind").alias("category"), *own.columns[2:], "at.path", "at.line_no", "at.module")
    return out.select("flow_ord", "category", "destination", "service_type", "data_type", "purpose", "role", "note", "pii", "jurisdiction", "needs_safeguards", "path", "line_no", "module")
