"""Sessions of deletes and their risk."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import micros, parent_path, process_identity, protected_root, stable_id, user_identity
from ledgerloom.operators.ordering import joined_with_nulls, numbered, segmented
from ledgerloom.options import HOUR, ProtectedRule, RiskOptions
from ledgerloom.plans.scratch import written

RISKS = ("informational", "warning", "critical")
KEY = ["process_identity", "user_identity", "scope_key"]


def with_session_key(deletes: DataFrame, rules: Sequence[ProtectedRule]) -> DataFrame:
    """Adds the identities, the path scope and whether the path is protected."""
    root = protected_root(F.col("full_path"), rules)
    scope = F.coalesce(root, parent_path(F.col("full_path")), F.concat(F.lit("unknown:"), "raw_event_id"))
    return deletes.select(
        "*",
        process_identity(F.col("process_guid"), F.col("computer_name"), F.col("process_id"), F.col("raw_event_id")).alias("process_identity"),
        user_identity(F.col("user_sid"), F.col("user_name"), F.col("raw_event_id")).alias("user_identity"),
        scope.alias("scope"),
        F.lower(scope).alias("scope_key"),
        root.isNotNull().alias("protected"),
        micros("occurred_ts").alias("us"),
    )


def sessionize(
    deletes: DataFrame, rules: Sequence[ProtectedRule] = (), options: RiskOptions = RiskOptions(), bucket_us: int = HOUR
) -> DataFrame:
    """Each delete with its session: a gap longer than the window opens a new one.

    A key (import, process, user and scope) is scanned in buckets of time (see ``segmented``);
    a gap just as long as the window stays inside. The session's number counts within the
    key and ``session_id`` names it by its key and first event; ``scope`` is spelt as in that event.
    """
    key = ["import_session_id", *KEY]
    first = F.struct("raw_event_id", "scope", "us")
    found = segmented(with_session_key(deletes, rules), key, "us", "record_ordinal", options.window_us, first, bucket_us)
    return found.withColumns(
        {"session_no": F.col("segment_no"), "first_raw_id": F.col("opened.raw_event_id"), "scope": F.col("opened.scope"), "opened_us": F.col("opened.us")}
    ).drop("segment_no", "opened").withColumn("session_id", stable_id("import_session_id", *KEY, "first_raw_id"))


def risk_rank(risk: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, RISKS)), risk)


def assess_risk(sessions: DataFrame, options: RiskOptions = RiskOptions()) -> DataFrame:
    """Adds risk and rule code: a protected path is critical, else the session's running count decides."""
    n = F.col("running_count")
    graded = lambda a, b, c, d: F.when(F.col("protected"), a).when(n >= options.critical, b).when(n >= options.warning, c).otherwise(d)
    return sessions.withColumns(
        {
            "risk": graded("critical", "critical", "warning", "informational"),
            "rule_code": graded("protected_root", f"burst_{options.critical}_in_window", f"burst_{options.warning}_in_window", "single_delete"),
        }
    )


def session_summary(assessed: DataFrame) -> DataFrame:
    """A row per session: when it opened and ended, its items, and its largest risk."""
    return assessed.groupBy("session_id", "import_session_id", "process_identity", "user_identity").agg(
        F.min_by("scope", F.struct("us", "record_ordinal")).alias("scope"),
        F.min_by("process_guid", F.struct("us", "record_ordinal")).alias("process_guid"),
        F.min_by("process_id", F.struct("us", "record_ordinal")).alias("process_id"),
        F.min("occurred_ts").alias("opened_ts"),
        F.max("occurred_ts").alias("last_ts"),
        F.count_distinct("raw_event_id").alias("items"),
        F.sum(F.col("protected").cast("long")).alias("protected_items"),
        F.max_by("risk", risk_rank(F.col("risk"))).alias("max_risk"),
    )


def session_ordinals(assessed: DataFrame) -> DataFrame:
    """(live_session_id, session_id, ordinal): sessions in the order of their first received record."""
    first = assessed.groupBy("live_session_id", "session_id").agg(F.min("received_sequence").alias("first_sequence"))
    return first.withColumn("ordinal", F.dense_rank().over(Window.partitionBy("live_session_id").orderBy("first_sequence")).cast("long"))


def last_rule(assessed: DataFrame) -> DataFrame:
    """The rule of each session's last received record, beside its largest risk; the two may disagree."""
    return assessed.groupBy("session_id").agg(
        F.max_by("rule_code", "record_ordinal").alias("last_rule_code"), F.max_by("risk", risk_rank(F.col("risk"))).alias("max_risk")
    )


def top_risk_paths(assessed: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` riskiest paths: by the risk of the sessions they are in, then by deletes, then by path."""
    risk = F.max(risk_rank(F.col("risk"))).over(Window.partitionBy("session_id"))
    paths = (
        assessed.withColumn("session_rank", risk)
        .where(F.trim("full_path") != "")
        .groupBy(F.lower("full_path").alias("path_key"))
        .agg(F.min_by("full_path", "record_ordinal").alias("path"), F.max("session_rank").alias("rank"), F.count("*").alias("deletes"))
    )
    return (
        paths.orderBy(F.desc("rank"), F.desc("deletes"), "path_key", "path").limit(n)
        .select("path", F.element_at(F.array(*map(F.lit, RISKS)), F.col("rank").cast("int")).alias("max_risk"), "deletes")
    )


FOLDED = "live_session_id string, raw_event_id string, received_sequence long, fold_session long, fold_count long, opened_us long, last_us long"


class ReceivedFold:
    """The sessions of one key, to which rows are added as received (see ``sessionize_received``)."""

    def __init__(self, window_us: int, next_no: int = 0, sessions: Sequence[tuple] = ()) -> None:
        self.window, self.next_no = window_us, next_no
        #: By number: opening, last event, ids.
        self.sessions: dict[int, list] = {no: [opened, last, set(ids)] for no, opened, last, ids in sessions}
        #: (last event, -number) in order.
        self.lasts = sorted((s[1], -no) for no, s in self.sessions.items())

    def add(self, us: int, raw_event_id: str) -> tuple[int, int, int, int]:
        """The row's session, its count, opening and last event so far."""
        no = None
        begin, end = bisect_left(self.lasts, (us - self.window, -(1 << 62))), bisect_right(self.lasts, (us + self.window, 1))
        for last, minus in reversed(self.lasts[begin:end]):
            if us >= self.sessions[-minus][0] - self.window:
                no = -minus
                break
        if no is None:
            no = self.next_no
            self.next_no += 1
            self.sessions[no] = [us, us, set()]
            insort(self.lasts, (us, -no))
        own = self.sessions[no]
        if raw_event_id not in own[2]:
            own[2].add(raw_event_id)
            if us > own[1]:
                del self.lasts[bisect_left(self.lasts, (own[1], -no))]
                own[1] = us
                insort(self.lasts, (us, -no))
        return no, len(own[2]), own[0], own[1]

    def forget_before(self, us: int) -> None:
        """Drop the sessions whose last event is earlier."""
        while self.lasts and self.lasts[0][0] < us:
            del self.sessions[-self.lasts.pop(0)[1]]


def sessionize_received(deletes: DataFrame, rules: Sequence[ProtectedRule] = (), options: RiskOptions = RiskOptions(), bucket_us: int = HOUR) -> DataFrame:
    """Sessions of live rows, which are taken as received and not by time.

    A row joins the session with the latest last event whose distance is within the window,
    unless it is earlier than the opening by more than the window; the last event never
    moves back and a repeated id adds nothing. So no session spans a gap in event times that is
    wider than the window: each key (live session, process, user, scope) is cut at such gaps
    and its parts are folded apart, as the order of receipt decides within a part. A task streams
    through its sorted rows and holds the sessions of one part, not its rows. Sessions are
    numbered within the key by their first row received.
    """
    keys = ["live_session_id", *KEY]
    keyed = with_session_key(deletes, rules).select(*keys, "raw_event_id", "received_sequence", "us")
    parts = segmented(keyed, keys, "us", "received_sequence", options.window_us, F.struct("us"), bucket_us).withColumnRenamed("segment_no", "part")
    by = [*keys, "part"]
    ordered = parts.select(*by, "raw_event_id", "received_sequence", "us").repartition(*by).sortWithinPartitions(*by, "received_sequence")
    window = options.window_us
    columns = [*by, *(c.split()[0] for c in FOLDED.split(", ") if c.split()[0] not in by)]
    schema = ", ".join([f"{k} string" for k in keys] + ["part long"] + [c for c in FOLDED.split(", ") if c.split()[0] not in by])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = None, ReceivedFold(window)
        for batch in batches:
            out = []
            for *key, raw_event_id, sequence, us in batch.itertuples(index=False):
                if key != now:
                    now, own = key, ReceivedFold(window)
                out.append((*key, raw_event_id, sequence, *own.add(us, raw_event_id)))
            yield pd.DataFrame(out, columns=columns)

    folded = written(ordered.mapInPandas(fold, schema), "folded")
    firsts = folded.groupBy(*by, "fold_session").agg(F.min("received_sequence").alias("first_sequence"))
    ordinals = numbered(firsts, keys, "first_sequence", "ordinal").select(*by, F.col("fold_session"), (F.col("ordinal") - 1).alias("ordinal"))
    named = joined_with_nulls(folded, ordinals, [*by, "fold_session"])
    return named.withColumn("fold_session", F.col("ordinal")).select(*(c.split()[0] for c in FOLDED.split(", ")))
