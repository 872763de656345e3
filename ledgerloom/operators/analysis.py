"""Analysis of one stored capture."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import micros
from ledgerloom.operators.correlate import correlate, permitted, trim_candidates
from ledgerloom.operators.ordering import nearest_k, numbered
from ledgerloom.operators.sessions import RISKS, assess_risk, risk_rank, sessionize_received, with_session_key
from ledgerloom.options import SECOND, CorrelationOptions, ProtectedRule, RiskOptions

MAX_RECORDS = 5_000
CANDIDATES, GRACE_US = 512, 30 * SECOND
USABLE = ("delete_fact", "process_context", "security_evidence")


def usable_records(records: DataFrame, limit: int = MAX_RECORDS) -> DataFrame:
    """Per capture the first usable records in received order, and whether there were more (``truncated``)."""
    placed = numbered(records.where(F.col("outcome").isin(*USABLE)), ["live_session_id"], "received_sequence", "place")
    rows = placed.where(F.col("place") <= limit + 1)
    more = F.max("place").over(Window.partitionBy("live_session_id")) > limit  # over limit + 1 rows at most
    return rows.withColumn("truncated", more).where(F.col("place") <= limit).drop("place")


def near_candidates(deletes: DataFrame, others: DataFrame, kind: str, limit_us: int, keep: int = CANDIDATES) -> DataFrame:
    """(d_id, kind, delta, ordinal, partner): of each delete the nearest others in time, whatever else they have in common."""
    d = deletes.select(F.col("raw_event_id").alias("d_id"), micros("occurred_ts").alias("us"))
    o = others.select(F.col("raw_event_id").alias("partner"), F.col("record_ordinal").alias("ordinal"), micros("occurred_ts").alias("o_us"))
    found = nearest_k(d, o, ("us", "o_us"), "ordinal", keep, limit_us)
    return trim_candidates(found.select("d_id", F.lit(kind).alias("kind"), "delta", "ordinal", "partner"), keep, limit_us)


def analyze_session(
    records: DataFrame, session: str, rules: Sequence[ProtectedRule] = (), correlation: CorrelationOptions = CorrelationOptions(),
    risk: RiskOptions = RiskOptions(), limit: int = MAX_RECORDS, grace_us: int = GRACE_US,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(deletes with match, session and risk; sessions; counters of one row) for one capture.

    Candidates are the nearest ``CANDIDATES`` processes and evidence within the window and
    ``grace_us``, so all pairs of a capture's at most ``limit`` records are the most it makes.
    Sessions are numbered by their first delete; a session bears its largest risk and the
    rule of its last delete, which may disagree. Records that could not be parsed are counted.
    """
    own = records.where(F.col("live_session_id") == session)
    rows = usable_records(own, limit)
    d, p = rows.where("outcome = 'delete_fact'").drop("command_line"), rows.where("outcome = 'process_context'")
    s = rows.where("outcome = 'security_evidence'")
    reach = correlation.window_us + grace_us
    allowed = near_candidates(d, p, "process", reach).unionByName(near_candidates(d, permitted(s), "security", reach)).select("d_id", "partner")
    found = correlate(d, p, s, correlation, allowed)
    folded = sessionize_received(d, rules, risk).select("raw_event_id", "received_sequence", "fold_session", "fold_count", "opened_us", "last_us")
    keyed = with_session_key(d, rules).select("raw_event_id", "received_sequence", "process_identity", "user_identity", "scope", "scope_key", "protected")
    graded = assess_risk(folded.join(keyed, ["raw_event_id", "received_sequence"]).withColumn("running_count", F.col("fold_count")), risk)
    key = ["process_identity", "user_identity", "scope_key", "fold_session"]
    sessions = graded.groupBy(*key).agg(
        F.min("received_sequence").alias("first_sequence"), F.min_by("scope", "received_sequence").alias("scope"), F.max("fold_count").alias("items"), F.min("opened_us").alias("opened_us"),
        F.max("last_us").alias("last_us"), F.count_if("protected").alias("protected_items"), F.max(risk_rank(F.col("risk"))).alias("rank"), F.max_by("rule_code", "received_sequence").alias("rule_code"),
    )
    ordinal = F.row_number().over(Window.orderBy("first_sequence"))  # of one capture's sessions
    sessions = sessions.select(
        ordinal.cast("long").alias("ordinal"), *key, "scope", "items", "protected_items", "opened_us", "last_us",
        F.element_at(F.array(*map(F.lit, RISKS)), F.col("rank").cast("int")).alias("max_risk"), "rule_code",
    )
    matched = found.join(graded.join(sessions.select(*key, "ordinal"), key).select("raw_event_id", "received_sequence", "ordinal", "fold_count", "risk", "rule_code", "protected"), "raw_event_id")
    n = lambda outcome: F.count_if(F.col("outcome") == outcome)
    counters = rows.agg(
        F.count("*").alias("records"), n("delete_fact").alias("deletes"), n("process_context").alias("processes"), n("security_evidence").alias("evidence"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated")
    )
    unparsable = own.agg(n("error").alias("unparsable"))
    alone = found.agg(F.count_if(F.col("method") == "none").alias("uncorrelated"))
    return matched, sessions.drop("scope_key", "fold_session"), counters.join(unparsable).join(alone)  # one row each
