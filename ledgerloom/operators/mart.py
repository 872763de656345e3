"""The audit mart: the related tables of an import, from parsed records, correlated deletes and assessed sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import stable_id
from ledgerloom.operators.sessions import session_summary

SCORES = {"none": 0, "low": 25, "medium": 75, "high": 100}
STORED_RULES = {"warning": "burst_30_in_10s", "critical": "burst_100_in_10s"}


def correlation_score() -> Column:
    score = F.lit(None).cast("int")
    for confidence, points in SCORES.items():
        score = F.when(F.col("confidence") == confidence, points).otherwise(score)
    return score


def build_audit_mart(records: DataFrame, deletes: DataFrame, processes: DataFrame, correlated: DataFrame, assessed: DataFrame) -> dict[str, DataFrame]:
    """Tables by name, with deterministic ids and the stored spellings.

    Stored rule codes are fixed names of the grade, whatever the thresholds were; the code
    that applied is kept beside them. A session row carries its final state and the ids of
    its first event. ``records`` (raw_event_id, import_session_id, record_ordinal,
    occurred_ts, outcome) are all records of the imports.
    """
    first = assessed.groupBy("session_id").agg(F.min_by("raw_event_id", F.struct("us", "record_ordinal")).alias("first_raw_event_id"))
    stored = F.when(F.col("rule_code").startswith("burst_"), F.when(F.col("risk") == "critical", STORED_RULES["critical"]).otherwise(STORED_RULES["warning"])).otherwise(F.col("rule_code"))
    assessment = assessed.withColumn("assessment_id", stable_id(F.lit("assessment"), "raw_event_id"))
    totals = records.groupBy("import_session_id").agg(F.min("occurred_ts").alias("started_ts"), F.count("*").alias("records"), F.count_if(F.col("outcome") == "error").alias("errors"))
    sessions = assessed.groupBy("import_session_id").agg(F.count("*").alias("deletes"), F.count_distinct("session_id").alias("sessions"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("deletes", "sessions")}
    return {
        "import_sessions": totals.join(sessions, "import_session_id", "left").withColumns(zero),
        "import_records": records.select("import_session_id", "record_ordinal", "raw_event_id", "outcome"),
        "delete_events": deletes.select("raw_event_id", "import_session_id", "occurred_ts", "computer_name", "full_path", "process_id", "process_path", "process_guid", "user_name", "user_sid"),
        "process_observations": processes.select("raw_event_id", "import_session_id", F.col("occurred_ts").alias("started_ts"), "computer_name", "process_id", "process_guid", "process_path", "command_line", "user_name", "user_sid"),
        "event_correlations": correlated.select("raw_event_id", "method", "confidence", correlation_score().alias("score"), "delta_ms", "process_raw_id", "security_raw_id", "identity_enriched", F.to_json("reasons").alias("reasons_json")),
        "event_evidence": deletes.select("raw_event_id", F.col("raw_event_id").alias("evidence_raw_id"), F.lit("primary_delete").alias("kind"), F.lit(100).alias("score")),
        "delete_sessions": session_summary(assessed).join(first, "session_id"),
        "session_members": assessed.select("session_id", "raw_event_id", "running_count"),
        "risk_assessments": assessment.select("assessment_id", F.lit("delete_session").alias("subject_kind"), "session_id", "risk", stored.alias("rule_code"), F.to_json(F.struct(F.col("rule_code").alias("originalRuleCode"))).alias("details_json")),
        "risk_assessment_links": assessment.select("assessment_id", "raw_event_id", "session_id"),
    }
