"""Counts and statuses of imports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.sessions import RISKS, risk_rank

CONFIDENCES = ("none", "low", "medium", "high")


def confidence_counts(correlated: DataFrame) -> DataFrame:
    """(confidence, n) for every confidence, absent ones with 0."""
    every = correlated.sparkSession.createDataFrame([(c,) for c in CONFIDENCES], "confidence string")
    counts = correlated.groupBy("confidence").agg(F.count("*").alias("n"))
    return F.broadcast(every).join(counts, "confidence", "left").select("confidence", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def import_status(totals: Column, errors: Column, fatal: Column, sink_failed: Column) -> Column:
    """failed if fatal or nothing but errors, partial_failure with some errors or a failed sink, else completed."""
    return F.when(fatal | ((errors > 0) & (errors == totals)), "failed").when((errors > 0) | sink_failed, "partial_failure").otherwise("completed")


def import_totals(records: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Per import the outcomes' counts and the status.

    ``records`` has import_session_id and outcome; ``events`` (import_session_id, event) names
    what else happened: ``fatal`` and ``sink_failed``.
    """
    n = lambda condition: F.count_if(condition)
    totals = records.groupBy("import_session_id").agg(
        F.count("*").alias("records"),
        n(F.col("outcome") == "error").alias("errors"),
        n(F.col("outcome") == "ignored").alias("ignored"),
        n(~F.col("outcome").isin("error", "ignored")).alias("succeeded"),
    )
    if events is None:
        return totals.withColumn("status", import_status(F.col("records"), F.col("errors"), F.lit(False), F.lit(False)))
    happened = events.groupBy("import_session_id").agg(
        F.bool_or(F.col("event") == "fatal").alias("fatal"), F.bool_or(F.col("event") == "sink_failed").alias("sink_failed")
    )
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("records", "errors", "ignored", "succeeded")}
    off = {c: F.coalesce(c, F.lit(False)) for c in ("fatal", "sink_failed")}
    both = totals.join(happened, "import_session_id", "full").withColumns(zero | off)
    status = import_status(F.col("records"), F.col("errors"), F.col("fatal"), F.col("sink_failed"))
    return both.withColumn("status", status).drop("fatal", "sink_failed")


def events_per_type(records: DataFrame) -> DataFrame:
    """Per import and event type the number of records."""
    return records.groupBy("import_session_id", "event_type").agg(F.count("*").alias("n"))


def dashboard(imports: DataFrame, sessions: DataFrame, deletes: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row of eight numbers: imports, sessions, delete events, warning and critical sessions, warning and error diagnostics, start of the last import."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    parts = (
        imports.agg(F.count("*").alias("imports"), F.max("started_ts").alias("last_import_start")),
        sessions.agg(F.count("*").alias("sessions"), n("max_risk", "warning").alias("warning_sessions"), n("max_risk", "critical").alias("critical_sessions")),
        deletes.agg(F.count("*").alias("delete_events")),
        diagnostics.agg(n("severity", "warning").alias("warning_diagnostics"), n("severity", "error").alias("error_diagnostics")),
    )
    return reduce(lambda a, b: a.join(b), parts)  # one row each


def import_report(records: DataFrame, correlated: DataFrame, assessed: DataFrame) -> DataFrame:
    """The report of each import as rows (import_session_id, item, key, n).

    Items: parsed_success and parsed_failure (ignored records count as parsed), event_id by
    id, delete_facts, confidence by name with absent ones as 0, and sessions by the risk
    warning or critical, also with 0. ``records`` has import_session_id, outcome and
    event_id; ``correlated`` import_session_id and confidence; ``assessed`` is that of the
    sessions. All counts are aggregations with map-side sums.
    """
    none = F.lit(None).cast("string")
    row = lambda item, key, n: F.struct(F.lit(item).alias("item"), key.alias("key"), n.cast("long").alias("n"))
    parsed = records.groupBy("import_session_id").agg(F.count_if(F.col("outcome") != "error").alias("good"), F.count_if(F.col("outcome") == "error").alias("bad"))
    confidences = correlated.groupBy("import_session_id").agg(*(F.count_if(F.col("confidence") == c).alias(c) for c in CONFIDENCES))
    risk = F.max(risk_rank(F.col("risk")))
    graded = assessed.groupBy("import_session_id", "session_id").agg(risk.alias("rank")).groupBy("import_session_id").agg(
        *(F.count_if(F.col("rank") == i + 1).alias(r) for i, r in enumerate(RISKS))
    )
    one = parsed.join(confidences, "import_session_id", "left").join(graded, "import_session_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    items = [
        row("parsed_success", none, F.col("good")), row("parsed_failure", none, F.col("bad")),
        row("delete_facts", none, reduce(lambda a, b: a + b, map(zero, CONFIDENCES))),
        *(row("confidence", F.lit(c), zero(c)) for c in CONFIDENCES), *(row("sessions", F.lit(r), zero(r)) for r in RISKS[1:]),
    ]
    events = records.where("event_id IS NOT NULL").groupBy("import_session_id", F.col("event_id").cast("string").alias("key")).agg(F.count("*").alias("n"))
    return one.select("import_session_id", F.inline(F.array(*items))).unionByName(events.select("import_session_id", F.lit("event_id").alias("item"), "key", "n"))
