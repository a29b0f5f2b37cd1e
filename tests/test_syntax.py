"""Syntax trees of source files: imports that line patterns miss, model names, services and flows."""

from tracewell.operators import flows, syntax

FILES = {
    "a.py": 'import os, openai\n\ndef f():\n    from langchain.chains import (\n        x,\n        y,\n    )\n    import numpy as np; import redis.client\n    return openai.run(model="gpt-4o-mini", other="no", long=(\n        "claude-"\n        "opus-4"))\n',
    "b.py": "from . import mine\nfrom .deep import other\ntext = 'import anthropic'\n# import cohere\nif True:\n    import google.cloud.storage as s, \\\n        sqlalchemy.orm\n    import boto3\nboto3.client('s3'); boto3.resource(\"dynamodb\")\n",
    "broken.py": "import faiss\ndef f(:\n    import httpx\n",
    "nul.py": "import \0x",
    "empty.py": None,
    "bad.py": 'x = "\\ud800"\nimport qdrant_client.http\n',
    "c.ts": "import pg from 'pg'\nconst a = require('axios'); const b = require(\"mongodb/lib\"); import c from 'axios/more'\nimport {\n  x } from 'ioredis'\n",
    "d.md": "import openai",
}


def table(spark, names=FILES):
    return spark.createDataFrame([(n, FILES[n]) for n in names], "path string, text string")


def test_imports_are_those_of_the_tree(spark):
    got = sorted((r["path"], r["line_no"], r["module"], r["parsed"]) for r in syntax.imports(table(spark)).collect())
    assert got == [
        ("a.py", 1, "openai", True), ("a.py", 1, "os", True), ("a.py", 4, "langchain.chains", True), ("a.py", 8, "numpy", True), ("a.py", 8, "redis.client", True),
        ("b.py", 2, "deep", True), ("b.py", 6, "google.cloud.storage", True), ("b.py", 6, "sqlalchemy.orm", True), ("b.py", 8, "boto3", True), ("bad.py", 2, "qdrant_client.http", True),
        ("broken.py", 1, "faiss", False), ("broken.py", 3, "httpx", False),
    ]


def test_models_of_texts(spark):
    assert sorted((r["path"], r["line_no"], r["model"]) for r in syntax.model_refs(table(spark)).collect()) == [("a.py", 9, "gpt-4o-mini"), ("a.py", 10, "claude-opus-4")]


def test_usages_and_flows(spark):
    used = syntax.usages(table(spark))
    got = sorted((r["path"], r["line_no"], r["kind"], r["what"], r["library"]) for r in used.collect())
    assert got == [
        ("a.py", 1, "ai_provider", "openai", "openai"), ("a.py", 1, "cloud", "azure:openai", "openai"), ("a.py", 4, "ai_provider", "langchain", "langchain"), ("a.py", 8, "database", "redis", "redis"),
        ("b.py", 6, "cloud", "gcp:cloud_storage", "google.cloud.storage"), ("b.py", 6, "database", "postgresql", "sqlalchemy"), ("b.py", 8, "cloud", "aws:lambda", "boto3"), ("b.py", 9, "cloud", "aws:dynamodb", "boto3"), ("b.py", 9, "cloud", "aws:s3", "boto3"),
        ("bad.py", 2, "vector_db", "qdrant", "qdrant"), ("c.ts", 1, "database", "postgresql", "pg"), ("c.ts", 2, "database", "mongodb", "mongoose"), ("c.ts", 2, "http", "axios", "axios"),
    ]
    found = syntax.data_flows(used)
    assert [(r["destination"], r["role"], r["purpose"], r["path"], r["line_no"]) for r in found.orderBy("flow_ord").collect()] == [
        ("OpenAI API", "processor", "inference", "a.py", 1), ("Qdrant", "processor", "storage", "bad.py", 2), ("Redis (redis)", "controller", "storage", "a.py", 8), ("Postgresql (sqlalchemy)", "controller", "storage", "b.py", 6),
        ("Postgresql (pg)", "controller", "storage", "c.ts", 1), ("Mongodb (mongoose)", "controller", "storage", "c.ts", 2), ("AZURE openai", "processor", "storage", "a.py", 1), ("GCP cloud_storage", "processor", "storage", "b.py", 6),
        ("AWS lambda", "processor", "storage", "b.py", 8), ("AWS dynamodb", "processor", "storage", "b.py", 9), ("AWS s3", "processor", "storage", "b.py", 9),
    ]
    records = {r["recipient"]: r["transfers"] for r in flows.records_of_processing(found).collect()}
    assert records["Redis (redis)"] == flows.INTERNAL and "Cross-border transfer (US)" in records["OpenAI API"] and "SCC" not in records["Qdrant"]


def test_no_files(spark):
    assert syntax.data_flows(syntax.usages(table(spark, ["d.md", "empty.py"]))).count() == 0
