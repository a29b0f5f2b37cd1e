"""Records of processing made of data flows.

Flows are (flow_ord, destination, purpose, data_type, role, note, jurisdiction, needs_safeguards). Of flows of equal destination the first or the last
decides, by flow_ord; groups are never collected, since both are aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts of the record of processing, with the words for type of data and destination.
ACTIVITIES = {
    "inference": "Sending {data_type} to {destination} for AI inference", "storage": "Storing {data_type} in {destination}", "training": "Using {data_type} for model training via {destination}",
    "monitoring": "Logging {data_type} to {destination} for monitoring", "api_call": "Sending data to {destination} via API",
}
OTHER_ACTIVITY = "Processing {data_type} via {destination}"
PURPOSES = {"inference": "AI-powered content generation and analysis", "storage": "Data persistence and retrieval", "training": "Model improvement and fine-tuning", "monitoring": "System monitoring and compliance logging", "api_call": "External service integration"}
CATEGORIES = {
    "prompts": "User-generated text content (may contain personal data)", "embeddings": "Vector representations of text content (derived personal data)", "user_data": "User records and associated data",
    "model_responses": "AI-generated content", "model_data": "Model parameters and training data", "logs": "System logs and usage data",
}
INTERNAL = "Internal processing (no third-party transfer); your organization is the controller"
USUAL_ROLE = "the operating organization typically acts as {role} (verify per provider's DPA/terms)"
SAFEGUARDS = "Cross-border transfer ({jurisdiction}): requires SCCs or equivalent safeguards under GDPR Chapter V"


def _filled(text: str) -> Column:
    """The text with the columns that it names in braces; null counts as empty."""
    parts = text.replace("}", "{").split("{")
    return F.concat(*(F.coalesce(F.col(p), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def _told(column: str, texts: dict[str, str], other: Column) -> Column:
    return F.coalesce(*(F.when(F.col(column) == k, _filled(v)) for k, v in texts.items()), other)


def records_of_processing(flows: DataFrame) -> DataFrame:
    """recipient, activity, purpose, data_categories, transfers: one row for each destination and purpose, of the first such flow."""
    key = ["destination", "purpose"]
    rest = ["flow_ord", "data_type", "role", "note", "jurisdiction", "needs_safeguards"]
    first = flows.groupBy(*key).agg(F.min_by(F.struct(*rest), "flow_ord").alias("f")).select(*key, "f.*").withColumn("jurisdiction", F.coalesce(F.nullif("jurisdiction", F.lit("")), F.lit("non-EEA")))
    note = F.coalesce(F.nullif("note", F.lit("")), _filled(USUAL_ROLE))
    transfer = F.concat_ws("; ", _filled("Transfer to {destination}"), note, F.when(F.col("needs_safeguards"), _filled(SAFEGUARDS)))
    return first.select(
        F.col("destination").alias("recipient"), _told("purpose", ACTIVITIES, _filled(OTHER_ACTIVITY)).alias("activity"), _told("purpose", PURPOSES, F.col("purpose")).alias("purpose"),
        _told("data_type", CATEGORIES, F.col("data_type")).alias("data_categories"), F.when(F.col("role") == "controller", INTERNAL).otherwise(transfer).alias("transfers"),
    )


def service_roles(services: DataFrame, flows: DataFrame) -> DataFrame:
    """services (service) with the role of their first flow, for diagrams, and the purpose of the last, for reports; null without a flow."""
    ends = flows.groupBy(F.col("destination").alias("service")).agg(F.min_by("role", "flow_ord").alias("first_role"), F.max_by("purpose", "flow_ord").alias("last_purpose"))
    return services.join(ends, "service", "left")
