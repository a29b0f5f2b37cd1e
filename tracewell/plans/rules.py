"""The requirement catalogue as two small tables: requirements, and the evidence fields that each is scored on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Ids, severities, scopes, tiers and evidence fields of the rules.
# id | severity | applies to | tier or - | field:weight:check ... (weight 2 if required, else 1)
FIXED_RULES = """
BP-LLM-01 | recommended | all | quality | operation:2:non_empty provider:2:non_null model_used:2:non_null model_requested:1:non_null
BP-LLM-02 | recommended | all | quality | input_tokens:2:non_null output_tokens:2:non_null
BP-LLM-03 | recommended | all | quality | duration_ms:2:non_null
BP-LLM-04 | recommended | all | quality | error_type:2:present error_message:1:present finish_reasons:2:non_empty
BP-LLM-05 | best_practice | all | quality | temperature:1:non_null max_tokens:1:non_null
BP-LLM-06 | best_practice | all | quality | input_messages:1:non_empty output_messages:1:non_empty
BP-LLM-07 | recommended | all | quality | tool_calls:1:present tools_defined:1:present
BP-LLM-08 | recommended | all | quality | span_id:2:non_null parent_span_id:1:present trace_id:2:non_null
EU-AIA-IV-1a | mandatory | high_risk | structural | provider:1:non_null
EU-AIA-IV-1b | mandatory | high_risk | - |
EU-AIA-IV-1c | mandatory | high_risk | structural | model_used:1:non_null
EU-AIA-IV-1d | mandatory | high_risk | - |
EU-AIA-IV-1e | mandatory | high_risk | - |
EU-AIA-IV-1h | mandatory | high_risk | - |
EU-AIA-IV-2a | mandatory | high_risk | - |
EU-AIA-IV-2b | mandatory | high_risk | - |
EU-AIA-IV-2c | mandatory | high_risk | - |
EU-AIA-IV-2d | mandatory | high_risk | - |
EU-AIA-IV-2e | mandatory | high_risk | - |
EU-AIA-IV-2g | mandatory | high_risk | - |
EU-AIA-IV-2h | mandatory | high_risk | - |
EU-AIA-IV-3 | mandatory | high_risk | structural | start_time:1:non_null
EU-AIA-IV-4 | mandatory | high_risk | - |
EU-AIA-IV-5 | mandatory | high_risk | - |
EU-AIA-IV-6 | mandatory | high_risk | structural | model_used:1:non_null
EU-AIA-IV-7 | mandatory | high_risk | - |
EU-AIA-IV-8 | mandatory | high_risk | - |
EU-AIA-IV-9 | mandatory | high_risk | structural | start_time:1:non_null
EU-AIA-12.1 | mandatory | high_risk | structural | start_time:1:non_null
EU-AIA-12.2a | mandatory | high_risk | structural | error_type:1:present finish_reasons:1:present
EU-AIA-12.2b | mandatory | high_risk | structural | model_used:1:non_null
EU-AIA-12.2c | mandatory | high_risk | structural | operation:1:non_empty
EU-AIA-12.3a | mandatory | annex_iii_1a_biometric | deterministic | start_time:2:non_null end_time:2:non_null
EU-AIA-12.3b | mandatory | annex_iii_1a_biometric | deterministic | reference_database:2:non_empty
EU-AIA-12.3c | mandatory | annex_iii_1a_biometric | deterministic | matched_input_data:2:non_empty
EU-AIA-12.3d | mandatory | annex_iii_1a_biometric | deterministic | verification_personnel:2:non_empty
EU-AIA-19.1 | mandatory | high_risk | deterministic | start_time:2:non_null
EU-AIA-19.2 | mandatory | high_risk financial_institution | - |
EU-AIA-25.1a | mandatory | high_risk | - |
EU-AIA-25.1b | mandatory | high_risk | - |
EU-AIA-25.1c | mandatory | all | - |
EU-AIA-25.2 | mandatory | high_risk | - |
EU-AIA-25.4 | mandatory | high_risk | - |
EU-AIA-50.1 | mandatory | all human_interaction | structural | ai_disclosure:1:present
EU-AIA-50.2 | mandatory | all content_generation | structural | content_marking:1:present output_messages:1:non_empty
EU-AIA-50.3 | mandatory | emotion_recognition biometric_categorisation | - |
EU-AIA-50.4a | mandatory | all deep_fake | structural | content_marking:1:present
EU-AIA-50.4b | mandatory | all text_generation public_interest | structural | ai_disclosure:1:present
EU-AIA-50.5 | mandatory | all | - |
ISO-42001-4.1 | mandatory | all | - |
ISO-42001-5.1 | mandatory | all | - |
ISO-42001-6.1 | mandatory | all | - |
ISO-42001-7.1 | mandatory | all | - |
ISO-42001-8.1 | mandatory | all | structural | start_time:1:non_null
ISO-42001-8.4 | mandatory | all | - |
ISO-42001-9.1 | mandatory | all | structural | start_time:1:non_null end_time:1:non_null
ISO-42001-9.2 | mandatory | all | structural | trace_id:1:non_null
ISO-42001-10.1 | recommended | all | - |
NIST-MANAGE-4.1 | recommended | all | structural | start_time:1:non_null
NIST-MANAGE-4.3 | recommended | all | structural | error_type:1:present error_message:1:present
NIST-MEASURE-2.1 | recommended | all | structural | evaluations:1:present
NIST-MEASURE-2.4 | recommended | all | structural | start_time:1:non_null model_used:1:non_null error_type:1:present
NIST-MEASURE-2.5 | recommended | all | structural |
NIST-MEASURE-2.8 | recommended | all | structural | operation:1:non_empty provider:1:non_null
NIST-MEASURE-2.9 | recommended | all | structural | input_messages:1:non_empty output_messages:1:non_empty
NIST-MEASURE-3.1 | recommended | all | structural | error_type:1:present
SOC2-AI-CC6.1 | mandatory | all | structural | provider:1:non_null trace_id:1:non_null
SOC2-AI-CC7.2 | mandatory | all | structural | error_type:1:present finish_reasons:1:present
SOC2-AI-CC8.1 | mandatory | all | structural | model_used:1:non_null model_requested:1:non_null
SOC2-AI-A1.2 | mandatory | all | structural | start_time:1:non_null error_type:1:present
SOC2-AI-PI1.1 | mandatory | all | structural | finish_reasons:1:non_empty
SOC2-AI-C1.1 | mandatory | all | structural | provider:1:non_null
"""
# The name of a regulation by the start of its rules' ids.
REGULATIONS = {"BP": "LLM Observability Best Practices", "EU": "EU AI Act", "ISO": "ISO 42001", "NIST": "NIST AI RMF", "SOC2": "SOC 2 Trust Services Criteria"}


def parsed() -> tuple[list[tuple], list[tuple]]:
    """(requirements, evidence fields) as rows: (ord, id, regulation, severity, applies_to, tier) and (id, ord, field, weight, check)."""
    requirements, fields = [], []
    for i, line in enumerate(FIXED_RULES.strip().split("\n")):
        name, severity, scope, tier, evidence = (x.strip() for x in line.split("|"))
        requirements.append((i, name, REGULATIONS[name.split("-")[0]], severity, scope.split(), None if tier == "-" else tier))
        for j, item in enumerate(evidence.split()):
            field, weight, check = item.split(":")
            fields.append((name, j, field, int(weight), check))
    return requirements, fields


def requirements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(parsed()[0], "rule_ord int, rule_id string, regulation string, severity string, applies_to array<string>, tier string")


def evidence_fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(parsed()[1], "rule_id string, field_ord int, field string, weight int, check_type string")


def applicable(rules: DataFrame, risk_level: str = "high_risk", regulations: list[str] | None = None) -> DataFrame:
    """Rules without a scope, of this scope or of all; then, if regulations are named, only theirs."""
    out = rules.where(F.col("applies_to").isNull() | F.array_contains("applies_to", risk_level) | F.array_contains("applies_to", "all"))
    return out.where(F.col("regulation").isin(regulations)) if regulations else out


def sql_values() -> str:
    """The same two tables as common table expressions."""
    q = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    rules, fields = parsed()
    one = ", ".join(f"({i}, {q(n)}, {q(r)}, {q(s)}, [{', '.join(map(q, a))}], CAST({q(t)} AS VARCHAR))" for i, n, r, s, a, t in rules)
    two = ", ".join("(" + ", ".join(map(q, f)) + ")" for f in fields)
    return f"rules(rule_ord, rule_id, regulation, severity, applies_to, tier) AS (VALUES {one}),\nfields(rule_id, field_ord, field, weight, check_type) AS (VALUES {two})"
