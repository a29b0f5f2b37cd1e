"""A training-corpus pipeline: quality classifier, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes the table that its predecessor wrote. All but the last return the columns of documents; the last returns
the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import bytecnn, decontam, linededup, neardup, packing
from tracewell.llm.shared import cut, table, vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from labelled rows of documents that are not held out."""
    return bytecnn.stage(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three-line runs go, and with them documents of which nothing else is left."""
    return linededup.stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the lowest id stays."""
    return neardup.stage(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.stage(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    return packing.pack(docs, vocabulary(packing.VOCABULARY))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: The classifier is a trained network, which SQL cannot express; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs
