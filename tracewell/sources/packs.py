"""Packs of a user's own rules: YAML files of requirements, which inherit what their file says, and what is wrong with them.

A pack is a table of files (path, text), from a folder by `pack_files` or from anywhere else. Files are parsed in the tasks that have them; rules, evidence
fields and findings are tables made of the same parsed rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import source_tree

#: Bytes of files that a task has parsed at once; a file beyond that is alone.
AT_ONCE = 1 << 20
SEVERITIES = ("mandatory", "recommended", "best_practice")
#: Tag of rules that say something about several agents only.
MULTI_AGENT_ONLY = "multi_agent_only"
_FIELD = "struct<field_path:string,description:string,required:boolean,check_type:string,legal_basis:string,source_quote:string,note:string>"
_RULE = f"struct<id:string,regulation:string,article:string,title:string,description:string,severity:string,applies_to:array<string>,legal_text:string,framework_nature:string,check_type:string,verified_against_primary:boolean,compliance_tier:string,evidence_fields:array<{_FIELD}>>"


def pack_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, text of the .yaml files in a folder and all folders in it."""
    return source_tree(spark, folder, suffixes=".yaml", skipped="-").select("path", "text")


def inherited(entry: dict, file: dict) -> dict:
    """A rule with what it takes from its file where it says nothing itself; the regulation and its nature are always the file's."""
    own = {k: v for k, v in entry.items() if k not in ("regulation", "framework_nature")}
    return {"article": file.get("article", "Unknown"), "severity": "mandatory", "verified_against_primary": file.get("verified_against_primary", False)} | own | {"regulation": file.get("regulation", "Unknown"), "framework_nature": file.get("framework_nature")}


def faults(entry) -> list[str]:
    """What is wrong with a rule, one text for each broken field."""
    if not isinstance(entry, dict):
        return ["not a mapping"]
    out = [f"missing required field '{f}'" for f in ("id", "title", "description") if not entry.get(f)]
    for field in entry.get("evidence_fields") or []:
        out += [f"evidence_field missing '{f}'" for f in ("field_path", "description") if not isinstance(field, dict) or f not in field]
    severity = entry.get("severity", "mandatory")
    return out + ([f"invalid severity '{severity}'"] if severity not in SEVERITIES else [])


def _rows(text: str) -> Iterator[tuple]:
    import yaml

    try:
        file = yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except (yaml.YAMLError, ValueError, RecursionError):
        yield None, None, ["YAML parse error"]
        return
    if not isinstance(file, dict) or not isinstance(file.get("requirements"), list):
        yield None, None, ["no 'requirements' key found"]
        return
    for i, entry in enumerate(file["requirements"]):
        yield i, json.dumps(inherited(entry, file), default=str) if isinstance(entry, dict) else None, faults(entry)


def _told(found: list[tuple]) -> pa.RecordBatch:
    path, ord_, rule, wrong = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(ord_, pa.int32()), pa.array(rule, pa.string()), pa.array(wrong, pa.list_(pa.string()))], ["file", "rule_ord", "rule", "faults"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch has thousands of files, of which the rules take many times the files' size, so rows go on by some files at a time."""
    for batch in batches:
        found, size = [], 0
        for path, text in ((p.as_py(), t.as_py() or "") for p, t in zip(*batch.columns, strict=True)):
            found += [(path, *r) for r in _rows(text)]
            size += len(text)
            if size >= AT_ONCE:
                yield _told(found)
                found, size = [], 0
        if found:
            yield _told(found)


def parsed(files: DataFrame) -> DataFrame:
    """file, rule_ord, rule (null if it is no mapping), faults of files (path, text): a row for each rule, and one with rule_ord null for a file that is no YAML or has no
    requirements, with what is wrong. A null text is an empty file."""
    found = files.select("path", "text").mapInArrow(_parsed, "file string, rule_ord int, rule string, faults array<string>")
    return found.withColumn("rule", F.from_json("rule", _RULE))


def requirements(pack: DataFrame) -> DataFrame:
    """file, rule_ord, rule_id, regulation, article, title, description, severity, applies_to, tier, check_type, verified of a parsed pack: the rules without faults."""
    r = pack.where(F.col("rule").isNotNull() & (F.size("faults") == 0))
    named = {"rule_id": "id", "tier": "compliance_tier", "verified": "verified_against_primary"}
    return r.select("file", "rule_ord", *(F.col(f"rule.{named.get(c, c)}").alias(c) for c in ("rule_id", "regulation", "article", "title", "description", "severity", "applies_to", "tier", "check_type", "framework_nature", "legal_text", "verified")))


def evidence_fields(pack: DataFrame) -> DataFrame:
    """rule_id, field_ord, field_path, description, required, check_type, legal_basis, source_quote of the rules without faults; a field is required unless it says otherwise."""
    r = pack.where(F.col("rule").isNotNull() & (F.size("faults") == 0))
    each = r.select(F.col("rule.id").alias("rule_id"), F.posexplode("rule.evidence_fields").alias("field_ord", "f"))
    return each.select("rule_id", "field_ord", "f.field_path", "f.description", F.coalesce("f.required", F.lit(True)).alias("required"), F.coalesce("f.check_type", F.lit("non_null")).alias("check_type"), "f.legal_basis", "f.source_quote")


def findings(pack: DataFrame) -> DataFrame:
    """file, rule_ord, rule_id, fault: one row for each broken field of a rule, or for a file that cannot be read."""
    return pack.select("file", "rule_ord", F.col("rule.id").alias("rule_id"), F.explode("faults").alias("fault"))


def applicable_to(rules: DataFrame, traces: DataFrame, risk_level: str = "high_risk") -> DataFrame:
    """is_multi_agent and the columns of rules (rule_id, applies_to): of each kind of trace that there is among traces (is_multi_agent), the rules that apply at this
    risk level. Rules about several agents do not apply to traces of one. There are two kinds at most, so no rule meets more than two rows."""
    scope = F.col("applies_to").isNull() | F.array_contains("applies_to", risk_level) | F.array_contains("applies_to", "all")
    kinds = F.broadcast(traces.select("is_multi_agent").distinct())
    tagged = F.coalesce(F.array_contains("applies_to", MULTI_AGENT_ONLY), F.lit(False))
    return rules.where(scope).join(kinds, F.col("is_multi_agent") | ~tagged)
