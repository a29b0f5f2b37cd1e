"""The registered queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bytecnn, decontam, htmltext, linededup, lm, neardup, outliers, packing, piecetable, secrets, termshards, trietokens, variants
from .shared import table, vocabulary


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytecnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trietokens.count(table(spark, sf_dir, "documents"), vocabulary(trietokens.VOCABULARY))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.perplexities(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality_verdicts(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary(packing.VOCABULARY))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecetable.round_trip(table(spark, sf_dir, "documents"), vocabulary(piecetable.VOCABULARY))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termshards.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_minhash_near_dedup, op3_html_extraction, op4_token_counts, op5_line_dedup,
        op6_lm_scoring, op7_quality_rules, op8_benchmark_decontamination, op9_secret_scans, op10_packing,
        op11_sentencepiece, op12_spelling_variants, op13_source_divergence,
    )
}
SQL: dict[str, str] = {"op5_line_dedup": linededup.SQL, "op8_benchmark_decontamination": decontam.SQL, "op13_source_divergence": termshards.SQL}
