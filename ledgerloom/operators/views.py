"""Filters, paging and joined views over the audit tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import contains_ci, time_range
from ledgerloom.operators.sessions import RISKS, risk_rank

MAX_PAGE = 200
OUTCOMES = ("delete_fact", "process_context", "security_evidence", "ignored", "error")
PREVIEW = 262_144


@dataclass(frozen=True)
class EventQuery:
    """Optional conditions on deletes; those that are None are not part of the plan."""

    risk: str | None = None
    begin: str | None = None
    end: str | None = None
    path: str | None = None
    process: str | None = None

    def __post_init__(self) -> None:
        if self.risk is not None and self.risk not in RISKS:
            raise ValueError(f"unknown risk {self.risk}")


def _process(text: str | None, *columns: str) -> Column:
    wanted = (text or "").strip()
    if not wanted:
        return F.lit(True)
    found = F.col("process_id").cast("string") == wanted
    for c in columns:
        found = found | contains_ci(F.col(c), wanted)
    return F.coalesce(found, F.lit(False))


def _risk(risk: str | None, column: str) -> Column:
    return F.lit(True) if risk is None else F.col(column) == risk


def filter_events(df: DataFrame, q: EventQuery) -> DataFrame:
    """Deletes by risk, time, path and process (path or GUID contains, or the id equals)."""
    return df.where(
        _risk(q.risk, "risk") & time_range(F.col("occurred_ts"), q.begin, q.end) & contains_ci(F.col("full_path"), q.path)
        & _process(q.process, "process_path", "process_guid")
    )


def filter_sessions(df: DataFrame, q: EventQuery) -> DataFrame:
    """Sessions by risk, last event, scope and process (identity or GUID contains, or the id equals)."""
    return df.where(
        _risk(q.risk, "max_risk") & time_range(F.col("last_ts"), q.begin, q.end) & contains_ci(F.col("scope"), q.path)
        & _process(q.process, "process_identity", "process_guid")
    )


def filter_imports(df: DataFrame, status: str | None = None, begin: str | None = None, end: str | None = None, source: str | None = None) -> DataFrame:
    """Imports by status, start and source path."""
    if status not in (None, "completed", "partial_failure", "failed", "already_imported"):
        raise ValueError(f"unknown status {status}")
    state = F.lit(True) if status is None else F.col("status") == status
    return df.where(state & time_range(F.col("started_ts"), begin, end) & contains_ci(F.col("source_path"), source))


def filter_diagnostics(df: DataFrame, severity: str | None = None, begin: str | None = None, end: str | None = None, text: str | None = None) -> DataFrame:
    """Diagnostics by severity, time and text in code or message."""
    level = F.lit(True) if severity is None else F.col("severity") == severity
    return df.where(level & time_range(F.col("occurred_ts"), begin, end) & (contains_ci(F.col("code"), text) | contains_ci(F.col("message"), text)))


@dataclass(frozen=True)
class CaptureQuery:
    """Optional conditions on the records of a capture."""

    session: str | None = None
    begin: str | None = None
    end: str | None = None
    outcome: str | None = None
    provider: str | None = None
    channel: str | None = None
    event_id: int | None = None
    record_id: int | None = None
    error_code: str | None = None
    errors_only: bool = False
    first: int | None = None
    last: int | None = None

    def __post_init__(self) -> None:
        if self.outcome is not None and self.outcome not in OUTCOMES:
            raise ValueError(f"unknown outcome {self.outcome}")
        if self.first is not None and self.last is not None and self.first > self.last:
            raise ValueError("the smallest sequence must not exceed the largest")


def filter_capture_records(df: DataFrame, q: CaptureQuery) -> DataFrame:
    """Captured records by capture, observed time, outcome, texts, ids and received sequence.

    ``errors_only`` finds errors, and whatever else bears an error code, such as ignored
    records of unsupported events.
    """
    ok = F.lit(True)
    equal = ((q.session, "live_session_id"), (q.outcome, "outcome"), (q.event_id, "parsed_event_id"), (q.record_id, "event_record_id"))
    for wanted, column in equal:
        if wanted is not None:
            ok = ok & (F.col(column) == wanted)
    for wanted, column in ((q.provider, "provider_name"), (q.channel, "channel_name"), (q.error_code, "error_code")):
        if (wanted or "").strip():
            ok = ok & contains_ci(F.col(column), wanted)
    if q.begin is not None or q.end is not None:
        ok = ok & time_range(F.col("observed_ts"), q.begin, q.end)
    if q.first is not None:
        ok = ok & (F.col("received_sequence") >= q.first)
    if q.last is not None:
        ok = ok & (F.col("received_sequence") <= q.last)
    if q.errors_only:
        ok = ok & ((F.col("outcome") == "error") | F.col("error_code").isNotNull())
    return df.where(ok)


def filter_projected(df: DataFrame, session: str | None = None, source: str | None = None, path: str | None = None, process: str | None = None) -> DataFrame:
    """Projected records by session, source, path and process (path, GUID or command line)."""
    ok = F.lit(True)
    for condition, column in ((session, "live_session_id"), (source, "outcome")):
        if condition is not None:
            ok = ok & (F.col(column) == condition)
    return df.where(ok & contains_ci(F.col("full_path"), path) & _process(process, "process_path", "process_guid", "command_line"))


def page(df: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """A page in a total order, with the total and whether pages lie before and after it."""
    if offset < 0 or not 1 <= limit <= MAX_PAGE:
        raise ValueError("the offset must not be negative and the limit between 1 and 200")
    rows = df.orderBy(*order).offset(offset).limit(limit)
    total = df.agg(F.count("*").alias("total"))  # one row
    return rows.join(F.broadcast(total)).withColumns(
        {"has_previous": F.lit(offset > 0), "has_next": F.col("total") > offset + limit}
    )


def xml_preview(df: DataFrame, column: str = "raw_xml", size: int = PREVIEW) -> DataFrame:
    """The text's beginning, its length and whether it was cut; the text itself is left out."""
    c = F.col(column)
    return df.withColumns({"preview": F.substring(c, 1, size), "characters": F.length(c).cast("long"), "truncated": F.length(c) > size}).drop(column)


def capture_sessions(starts: DataFrame, completions: DataFrame, records: DataFrame) -> DataFrame:
    """Captures with their completion and stored records; without a completion a capture is incomplete."""
    stored = records.groupBy("live_session_id").agg(F.count("*").alias("stored"))
    joined = starts.join(completions, "live_session_id", "left").join(stored, "live_session_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return joined.select(
        "live_session_id", "started_ts", F.coalesce("final_state", F.lit("incomplete")).alias("state"), zero("classified").alias("classified"),
        zero("persisted").alias("persisted"), zero("stored").alias("stored"), F.greatest(F.lit(0), zero("classified") - zero("persisted")).alias("uncommitted"),
    )


def audit_view(deletes: DataFrame, raw: DataFrame, sessions: DataFrame, event_assessments: DataFrame) -> DataFrame:
    """Deletes with their raw event and session, and the risk to show.

    That is the top assessment of the event by risk and time, else its session's, else the
    initial one. A delete whose raw event or session is not stored is not shown.
    """
    top = event_assessments.groupBy("raw_event_id").agg(F.max_by("event_risk", F.struct(risk_rank(F.col("event_risk")), "assessed_ts")).alias("event_risk"))
    return deletes.join(raw, "raw_event_id").join(sessions, "session_id").join(top, "raw_event_id", "left").withColumn(
        "shown_risk", F.coalesce("event_risk", "max_risk", "initial_risk")
    )


def session_diagnostics(df: DataFrame, session: str, limit: int = 256) -> DataFrame:
    """The first diagnostics of one capture, by time and id."""
    return df.where(F.col("live_session_id") == session).orderBy("occurred_ts", "diagnostic_id").limit(limit)


def filter_capture_sessions(df: DataFrame, state: str | None = None, begin: str | None = None, end: str | None = None) -> DataFrame:
    """Captures (of ``capture_sessions``) by state and start."""
    if state not in (None, "stopped", "error", "incomplete"):
        raise ValueError(f"unknown state {state}")
    ok = F.lit(True) if state is None else F.col("state") == state
    return df.where(ok & time_range(F.col("started_ts"), begin, end))


def diagnostics_with_file(diagnostics: DataFrame, imports: DataFrame) -> DataFrame:
    """Diagnostics with the name of the file they are about."""
    return diagnostics.join(imports.select("import_session_id", "source_path"), "import_session_id")
