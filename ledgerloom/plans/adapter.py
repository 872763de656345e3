"""Audit rows from the table ``events``, by one query that Spark and DuckDB both run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.parse import event_xml
from ledgerloom.options import HOUR, CorrelationOptions, ProtectedRule, RiskOptions

#: The events are minutes apart, so the windows are scaled up and the counts down.
CORRELATION = CorrelationOptions(6 * HOUR)
RISK = RiskOptions(12 * HOUR, 3, 5)
RULES = (ProtectedRule("r1", "C:\\Lab\\d3"), ProtectedRule("r2", "C:\\Lab", enabled=False))

_SQL = """
SELECT event_id AS record_ordinal, event_id, event_type, value,
  'raw-' || lpad(CAST(event_id AS STRING), 9, '0') AS raw_event_id,
  'imp-' || CAST(CAST(floor(event_id / 5000.0) AS BIGINT) AS STRING) AS import_session_id,
  'live-' || CAST(CAST(floor(event_id / 2000.0) AS BIGINT) AS STRING) AS live_session_id,
  event_id % 2000 + 1 AS received_sequence,
  ts AS occurred_ts,
  CASE WHEN event_type IN ('click', 'view') THEN 'delete_fact'
       WHEN event_type = 'signup' THEN 'process_context'
       WHEN event_type = 'purchase' THEN 'security_evidence' ELSE 'error' END AS outcome,
  'LAB-' || CAST(user_id % 3 AS STRING) AS computer_name,
  CAST(1000 + user_id % 20 AS INT) AS process_id,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE '{g-' || CAST(user_id AS STRING) || '}' END AS process_guid,
  'C:' || chr(92) || 'Tools' || chr(92) || 'p' || CAST(user_id % 7 AS STRING) || '.exe' AS process_path,
  'LAB' || chr(92) || 'u' || CAST(user_id AS STRING) AS user_name,
  CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'S-1-5-21-' || CAST(user_id AS STRING) END AS user_sid,
  'C:' || chr(92) || 'Lab' || chr(92) || 'd' || CAST(user_id % 5 AS STRING) || chr(92) || 'f'
       || CAST(CAST(JSONK AS INT) % 10 AS STRING) || '.txt' AS full_path,
  CASE WHEN event_type <> 'purchase' OR event_id % 5 = 0 THEN 'not_observed'
       WHEN event_id % 5 = 1 THEN 'delete_child' ELSE 'delete' END AS delete_permission,
  CASE WHEN event_type = 'signup' THEN 'run ' || CAST(user_id AS STRING) END AS command_line
FROM EVENTS
"""

DUCK = "WITH RECURSIVE audit AS (" + _SQL.replace("JSONK", "json_extract_string(props, '$.k')").replace("EVENTS", "events") + ")"
DELETES = "SELECT * FROM audit WHERE outcome = 'delete_fact'"


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def audit_of(events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The audit rows of events, with the columns in ``keep``."""
    text = _SQL.replace("{", "{{").replace("}", "}}").replace("JSONK", "get_json_object(props, '$.k')")
    return events.sparkSession.sql(text.replace("\nFROM EVENTS", "".join(f", {c}" for c in keep) + " FROM {events}"), events=events)


def deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_rows(spark, sf_dir).where("outcome = 'delete_fact'").drop("command_line")


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_rows(spark, sf_dir).where("outcome = 'process_context'")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_rows(spark, sf_dir).where("outcome = 'security_evidence'")


#: Captures of 50 records each, with the event's XML; the machine is not always reported.
CAPTURE = 50
_CAPTURES = f"""
SELECT record_ordinal, CAST(floor(event_id / {CAPTURE}.0) AS BIGINT) AS session_no, 'cap-' || CAST(CAST(floor(event_id / {CAPTURE}.0) AS BIGINT) AS STRING) AS live_session_id,
  event_id % {CAPTURE} + 1 AS received_sequence,
  'cap-' || CAST(CAST(floor(event_id / {CAPTURE}.0) AS BIGINT) AS STRING) || ':' || CAST(event_id % {CAPTURE} + 1 AS STRING) AS live_evidence_id,
  record_ordinal AS event_record_id, CASE WHEN outcome = 'security_evidence' THEN 'Microsoft-Windows-Security-Auditing' ELSE 'Microsoft-Windows-Sysmon' END AS provider_name,
  CASE WHEN outcome = 'security_evidence' THEN 's' ELSE 'c' END AS channel_name, CASE WHEN event_id % 11 = 0 THEN NULL ELSE computer_name END AS machine_name,
  occurred_ts AS time_created_ts, occurred_ts + INTERVAL '1' SECOND AS observed_ts, raw_xml, xml_sha256 AS raw_xml_sha256, xml_sha256 AS parser_raw_event_id,
  CASE outcome WHEN 'delete_fact' THEN 23 WHEN 'process_context' THEN 1 WHEN 'security_evidence' THEN 4663 ELSE 99 END AS parsed_event_id,
  CASE WHEN outcome = 'error' OR outcome = 'security_evidence' AND delete_permission = 'not_observed' THEN 'ignored' ELSE outcome END AS outcome,
  CASE WHEN outcome = 'error' THEN 'parse_unsupportedevent' END AS error_code
FROM WRITTEN
"""


def _duck_xml() -> str:
    """``event_xml`` for DuckDB."""
    data = lambda name, c: f"coalesce('<Data Name=\"{name}\">' || {c} || '</Data>', '')"
    security = " || ".join((
        data("ObjectName", "full_path"), data("ProcessName", "process_path"), data("SubjectUserName", "user_name"), data("SubjectUserSid", "user_sid"),
        data("AccessMask", "CASE delete_permission WHEN 'delete' THEN '0x10000' WHEN 'delete_child' THEN '0x40' END"), data("ProcessId", "'0x' || printf('%x', process_id)"),
    ))
    other = " || ".join((
        data("UtcTime", "strftime(occurred_ts, '%Y-%m-%d %H:%M:%S.%f')"), data("TargetFilename", "full_path"), data("Image", "process_path"), data("User", "user_name"),
        data("ProcessId", "process_id"), data("ProcessGuid", "process_guid"), data("CommandLine", "command_line"),
    ))
    return (
        "'<Event><System><Provider Name=\"' || CASE outcome WHEN 'security_evidence' THEN 'Microsoft-Windows-Security-Auditing' ELSE 'Microsoft-Windows-Sysmon' END || '\"/><EventID>' || "
        "CASE outcome WHEN 'security_evidence' THEN '4663' WHEN 'process_context' THEN '1' WHEN 'delete_fact' THEN '23' ELSE '99' END || '</EventID><TimeCreated SystemTime=\"' || "
        "strftime(occurred_ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z\"/><EventRecordID>' || record_ordinal || '</EventRecordID><Channel>' || CASE outcome WHEN 'security_evidence' THEN 's' ELSE 'c' END "
        f"|| '</Channel><Computer>' || computer_name || '</Computer></System><EventData>' || CASE outcome WHEN 'security_evidence' THEN {security} ELSE {other} END || '</EventData></Event>'"
    )


DUCK_CAPTURES = f", written AS (SELECT *, sha256(raw_xml) AS xml_sha256 FROM (SELECT *, {_duck_xml()} AS raw_xml FROM audit)), cap AS ({_CAPTURES.replace('WRITTEN', 'written')})"


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit rows as records of captures."""
    return captures_of(audit_rows(spark, sf_dir))


def captures_of(audit: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Audit rows as records of captures, with the columns in ``keep``."""
    xml = audit.withColumn("raw_xml", event_xml(F.col("outcome"))).withColumn("xml_sha256", F.sha2("raw_xml", 256))
    return audit.sparkSession.sql(_CAPTURES.replace("\nFROM WRITTEN", "".join(f", {c}" for c in keep) + " FROM {written}"), written=xml)
