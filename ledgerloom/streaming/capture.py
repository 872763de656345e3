"""Live capture as Structured Streaming: reading, classifying, counting, storing and correlating records."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ledgerloom.functions.columns import delete_permission, micros, parse_int64
from ledgerloom.operators.correlate import correlate, newest_of_guid
from ledgerloom.operators.parse import parse_events
from ledgerloom.operators.sessions import KEY, ReceivedFold, with_session_key
from ledgerloom.options import SECOND, CorrelationOptions, ProtectedRule, RiskOptions
from ledgerloom.plans.scratch import stored

MAX_UNITS = 1_048_576
CODE_CUT, DETAIL_CUT = 128, 2048
GRACE_US = 30 * SECOND
OUTCOMES = ("delete_fact", "process_context", "security_evidence", "ignored", "error")
BATCH = "batch_id"
MARKS = "live_session_id string, last long"


def read_live(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A stream of captured rows from Parquet files that appear under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def utf16_units(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("long")


def split_oversized(records: DataFrame, column: str = "raw_xml", limit: int = MAX_UNITS) -> DataFrame:
    """Adds ``oversized``, and empties the text of such records, so that nothing parses it."""
    large = F.coalesce(utf16_units(F.col(column)) > limit, F.lit(False))
    return records.withColumn("oversized", large).withColumn(column, F.when(~F.col("oversized"), F.col(column)))


def source_mismatch(provider: Column, channel: Column, event_id: Column, reported: Column | None = None, record: str = "subscription") -> Column:
    """Why a record disagrees with the subscription that delivered it; the first of four reasons, else null.

    ``provider``, ``channel`` and ``event_id`` are what the XML states, ``reported`` the
    provider that the channel reported; a channel or reported provider that is null agrees.
    """
    s = F.col(record)
    accepted = (F.lower(provider) == F.lower(s["provider"])) & F.array_contains(s["event_ids"], event_id)
    return (
        F.when(s.isNull(), "unknown_subscription")
        .when(~F.coalesce(accepted, F.lit(False)), "event_not_accepted")
        .when(F.lower(channel) != F.lower(s["channel"]), "channel_mismatch")
        .when(F.lower(reported if reported is not None else F.lit(None).cast("string")) != F.lower(s["provider"]), "provider_mismatch")
    )


def classify_stream(records: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each record with just one outcome, its error code and detail; stateless, so it runs on streams and tables alike.

    ``records`` has channel_name and raw_xml, and may have what the channel reported:
    provider_name, machine_name, event_record_id and time_created_ts, which are preferred to
    what the XML states. ``subscriptions`` (channel, provider, event_ids) is a short list of
    what was subscribed to; it becomes a literal of the plan. The order: oversized, parse
    error, unsupported (ignored), source mismatch, delete, process, evidence, nothing (ignored).
    """
    listed = subscriptions.select("channel", "provider", "event_ids").collect()  # a few channels
    known = F.create_map(*(x for r in listed for x in (F.lit(r.channel.lower()), F.struct(F.lit(r.channel).alias("channel"), F.lit(r.provider).alias("provider"), F.array(*map(F.lit, r.event_ids)).alias("event_ids")))))
    reported = {"provider_name": "provider", "machine_name": "computer_name", "event_record_id": "record_id", "time_created_ts": "event_ts"}
    given = [c for c in reported if c in records.columns]
    parsed = parse_events(split_oversized(records.withColumnsRenamed({c: f"reported_{c}" for c in given})))
    parsed = parsed.withColumn("subscription", F.try_element_at(known, F.lower("channel_name")))
    told = F.col("reported_provider_name") if "provider_name" in given else None
    mismatch = source_mismatch(F.col("provider"), F.col("channel"), F.col("event_id"), told)
    permission = delete_permission(F.col("data")["accesslist"], parse_int64(F.col("data")["accessmask"]))
    parse = F.concat(F.lit("parse_"), F.replace("parse_error", F.lit("_"), F.lit("")))
    code = F.when(F.col("oversized"), "live_event_xml_too_large").otherwise(F.coalesce(parse, F.when(mismatch.isNotNull(), "event_source_mismatch")))
    outcome = (
        F.when(F.col("oversized"), "error").when(F.col("parse_error") == "unsupported_event", "ignored").when(code.isNotNull(), "error")
        .when(F.col("source") == "sysmon_delete", "delete_fact").when(F.col("source") == "sysmon_process", "process_context")
        .when((F.col("source") == "security_4663") & (permission != "not_observed"), "security_evidence").otherwise("ignored")
    )
    preferred = {c: F.coalesce(f"reported_{c}", x) if c in given else F.col(x) for c, x in reported.items()}
    detail = F.when(~F.col("oversized"), F.coalesce("parse_error", mismatch))
    out = parsed.withColumns({"outcome": outcome, "error_code": F.substring(code, 1, CODE_CUT), "error_detail": F.substring(detail, 1, DETAIL_CUT), **preferred})
    return out.drop("subscription", "data", *(f"reported_{c}" for c in given))


def capture_counters(records: DataFrame) -> DataFrame:
    """Per capture how many records were received and how many had each outcome.

    ``received`` = the outcomes + ``dropped``: numbers up to the largest received one that no
    record has are of records that were received but not kept. Late records (column
    ``late``, if there is one) are counted apart and stand outside of that sum.
    """
    late = F.coalesce("late", F.lit(False)) if "late" in records.columns else F.lit(False)
    counts = [F.count_if((F.col("outcome") == o) & ~late).alias(o) for o in OUTCOMES]
    kept, last = F.count_if(~late), F.max(F.when(~late, F.col("received_sequence")))
    received = F.greatest(kept, F.coalesce(last, F.lit(0)))
    return records.groupBy("live_session_id").agg(received.alias("received"), *counts, (received - kept).alias("dropped"), F.count_if(late).alias("late"))


def dedupe_stream(records: DataFrame, time: str = "occurred_ts", delay: str = "10 minutes") -> DataFrame:
    """Drops repeated deliveries of an evidence id within the delay."""
    timed = records.withColumn("event_time", F.col(time).cast("timestamp")).withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(["live_evidence_id"]).drop("event_time")


def split_late(records: DataFrame, stops: DataFrame) -> DataFrame:
    """Adds ``late``: the record came after its capture was stopped (stops: live_session_id, stopped_ts)."""
    return records.join(stops, "live_session_id", "left").withColumn("late", F.coalesce(F.col("occurred_ts") > F.col("stopped_ts"), F.lit(False)))


def append_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    """Stores one batch in a folder of its own, which a repeated run of the batch replaces.

    Late records (column ``late``) are left out. The batch is refused whole if an id is not
    its capture and sequence, a sequence is not positive, repeats, or is not above all that
    earlier batches stored of its capture, or a digest (raw_xml_sha256) is not that of the XML.
    Beside the store, ``path`` + ``_marks`` has each batch's largest sequence per capture, so
    what is stored is not read again.
    """
    rows = (batch.where("NOT late").drop("late") if "late" in batch.columns else batch).persist()
    try:
        own = F.concat_ws(":", "live_session_id", F.col("received_sequence").cast("string"))
        wrong = ~F.col("live_evidence_id").eqNullSafe(own) | (F.col("received_sequence") <= 0)
        if {"raw_xml", "raw_xml_sha256"} <= {*rows.columns}:
            wrong = wrong | ~F.col("raw_xml_sha256").eqNullSafe(F.sha2("raw_xml", 256))
        key = ["live_session_id", "received_sequence"]
        bad = rows.where(wrong).limit(1).count() or rows.groupBy(*key).count().where("count > 1").limit(1).count()
        marks = rows.groupBy("live_session_id").agg(F.min("received_sequence").alias("first"), F.max("received_sequence").alias("last"))
        before = stored(rows.sparkSession, f"{path}_marks", f"{MARKS}, {BATCH} long")
        if not bad and before is not None:
            high = before.where(F.col(BATCH) < batch_id).groupBy("live_session_id").agg(F.max("last").alias("high"))
            bad = marks.join(high, "live_session_id").where("first <= high").limit(1).count()
        if bad:
            raise ValueError("the batch breaks the capture's numbering or digests")
        rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
        marks.select("live_session_id", "last").write.mode("overwrite").parquet(f"{path}_marks/{BATCH}={batch_id}")
    finally:
        rows.unpersist()


def live_append_sink(stream: DataFrame, path: str, checkpoint: str):
    """Starts the query that stores a stream of classified records batch by batch."""
    return stream.writeStream.foreachBatch(lambda batch, n: append_batch(batch, path, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete_sessions(records: DataFrame, existing: DataFrame | None = None, faults: DataFrame | None = None, store: DataFrame | None = None) -> DataFrame:
    """Completion rows of captures that have none yet: final state, counters and the number of stored records.

    The state is ``error`` for captures in ``faults`` (live_session_id), else ``stopped``;
    ``store`` holds what was kept of the records (by default all that are not late).
    """
    counters = capture_counters(records)
    kept = store if store is not None else records.where("NOT late") if "late" in records.columns else records
    done = counters.join(kept.groupBy("live_session_id").agg(F.count("*").alias("persisted")), "live_session_id", "left")
    state = F.lit("stopped")
    if faults is not None:
        done = done.join(faults.select("live_session_id").distinct().withColumn("fault", F.lit(True)), "live_session_id", "left")
        state = F.when(F.col("fault"), "error").otherwise(state)
    classified = reduce(lambda a, b: a + b, map(F.col, OUTCOMES))
    out = done.select("live_session_id", state.alias("final_state"), "received", classified.alias("classified"), F.coalesce("persisted", F.lit(0)).cast("long").alias("persisted"), *OUTCOMES, "dropped", "late")
    return out if existing is None else out.join(existing.select("live_session_id"), "live_session_id", "left_anti")


def correlate_batch(batch: DataFrame, batch_id: int, store: str, out: str, options: CorrelationOptions = CorrelationOptions(), guid_us: int | None = None, last: bool = False) -> None:
    """Stores a batch of records and correlates the deletes that are due, by the rules of ``correlate``.

    A delete is due once the newest event is later than it by the window and ``GRACE_US`` (or
    at the ``last`` batch). A batch reads its own rows and what the one before left open
    (``out`` + ``_open``, a folder per batch): deletes that are not due, processes and evidence
    that those may still meet, the newest process of every GUID (``guid_us`` bounds how old
    it may be) and the newest row. The store is read only for deletes that come so late that
    their partners are no longer open. A delete does not wait for a process of its GUID that
    comes after it is due. All writes replace the batch's own folders, so a
    repeated batch changes nothing.
    """
    batch.write.mode("overwrite").parquet(f"{store}/{BATCH}={batch_id}")
    _correlate_stored(batch.sparkSession, batch_id, store, out, options, guid_us, last)


def _left_open(spark: SparkSession, out: str, batch_id: int) -> DataFrame | None:
    """What the batch before left open."""
    found = stored(spark, f"{out}_open/{BATCH}={batch_id - 1}")
    every = stored(spark, f"{out}_open") if found is None else None
    if every is not None:  # batches need not be numbered without gaps
        before = every.where(F.col(BATCH) < batch_id).agg(F.max(BATCH)).first()[0]
        found = None if before is None else spark.read.parquet(f"{out}_open/{BATCH}={before}")
    return found


def _correlate_stored(spark: SparkSession, batch_id: int, store: str, out: str, options: CorrelationOptions, guid_us: int | None, last: bool) -> None:
    us, reach = micros("occurred_ts"), options.window_us + GRACE_US
    rows = spark.read.parquet(f"{store}/{BATCH}={batch_id}")
    left = _left_open(spark, out, batch_id)
    passed = None  # deletes from here on were open, with all partners, before this batch
    if left is not None:
        newest = left.agg(F.max(us)).first()[0]
        passed = None if newest is None else newest - reach
        rows = left.unionByName(rows)
    newest = rows.agg(F.max(us)).first()[0]
    horizon = (newest or 0) - reach
    due = rows.where("outcome = 'delete_fact'").where(F.lit(last) | (us < horizon) | us.isNull())
    near = rows
    if passed is not None:
        oldest = due.where(us < passed).agg(F.min(us)).first()[0]
        if oldest is not None:
            every = spark.read.parquet(store).where(F.col(BATCH) <= batch_id).drop(BATCH)
            near = every if guid_us is None else every.where(us >= oldest - max(reach, guid_us))
    processes, evidence = (near.where(F.col("outcome") == o) for o in ("process_context", "security_evidence"))
    correlate(due.drop("command_line"), processes, evidence, options).write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")
    is_process, recent = F.col("outcome") == "process_context", us >= horizon - options.window_us
    pending = (F.col("outcome") == "delete_fact") & (us >= horizon) & F.lit(not last)
    partner = recent & (is_process | (F.col("outcome") == "security_evidence"))
    mark = (us == newest) & ~F.col("outcome").isin("delete_fact", "process_context", "security_evidence")
    old = newest_of_guid(rows.where(is_process & ~recent & (F.lit(True) if guid_us is None else us >= horizon - guid_us)))
    kept = rows.where(pending | partner | F.coalesce(mark, F.lit(False))).unionByName(old)
    if last:  # the time that was reached stays known without its delete
        kept = kept.unionByName(rows.where((F.col("outcome") == "delete_fact") & (us == newest)).limit(1).withColumn("outcome", F.lit("ignored")))
    kept.write.mode("overwrite").parquet(f"{out}_open/{BATCH}={batch_id}")


def flush_correlation(spark: SparkSession, store: str, out: str, options: CorrelationOptions = CorrelationOptions(), guid_us: int | None = None) -> None:
    """Correlates what the newest batch left open, as at the end of a capture; may be repeated, and later batches go on behind it."""
    every = stored(spark, f"{out}_open")
    newest = None if every is None else every.agg(F.max(BATCH)).first()[0]
    if newest is not None:
        _correlate_stored(spark, newest, store, out, options, guid_us, last=True)


def stream_correlate(stream: DataFrame, store: str, out: str, checkpoint: str, options: CorrelationOptions = CorrelationOptions(), guid_us: int | None = None):
    """Starts the query that correlates a stream of classified records batch by batch; the deletes of the last moments wait for ``flush_correlation``."""
    run = lambda batch, n: correlate_batch(batch, n, store, out, options, guid_us)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def correlate_to_end(stream: DataFrame, store: str, out: str, checkpoint: str, options: CorrelationOptions = CorrelationOptions(), guid_us: int | None = None) -> DataFrame:
    """Correlates all that the stream has now, the last deletes included, and returns every delete with its matches."""
    stream_correlate(stream, store, out, checkpoint, options, guid_us).awaitTermination()
    spark = stream.sparkSession
    flush_correlation(spark, store, out, options, guid_us)
    return spark.read.parquet(out).drop(BATCH)


SESSION_EVENTS = "raw_event_id string, session_no long, count long, opened_us long, last_us long"
SESSION_STATE = "next_no long, number array<long>, opened array<long>, last array<long>, ids array<array<string>>"


def stream_sessions(deletes: DataFrame, rules: tuple[ProtectedRule, ...] = (), options: RiskOptions = RiskOptions(), delay_us: int = GRACE_US) -> DataFrame:
    """The received-order fold on a stream: each delete with its session and running count.

    A key's state holds the sessions that may still be joined, those within two windows of
    the newest, and is dropped when the watermark (``delay_us`` behind the newest event) has
    passed them; what comes later than that opens sessions numbered anew.
    """
    window = options.window_us
    timed = deletes.withColumn("event_time", F.col("occurred_ts").cast("timestamp")).withWatermark("event_time", f"{delay_us} microseconds")
    keyed = with_session_key(timed, rules).select("live_session_id", *KEY, "raw_event_id", "received_sequence", micros("occurred_ts").alias("us"), "event_time")

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = ReceivedFold(window)
        if state.exists:
            next_no, numbers, opened, last, ids = state.get
            own = ReceivedFold(window, next_no, list(zip(numbers, opened, last, ids, strict=True)))
        rows = pd.concat(list(batches)).sort_values("received_sequence")
        out = [(i, *own.add(us, i)) for i, us in zip(rows["raw_event_id"], rows["us"].tolist(), strict=True)]
        newest = own.lasts[-1][0]
        own.forget_before(newest - 2 * window)
        numbers = list(own.sessions)
        state.update((own.next_no, numbers, *([own.sessions[n][i] for n in numbers] for i in (0, 1)), [sorted(own.sessions[n][2]) for n in numbers]))
        state.setTimeoutTimestamp(max((newest + 2 * window) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["raw_event_id", "session_no", "count", "opened_us", "last_us"])

    return keyed.groupBy("live_session_id", *KEY).applyInPandasWithState(fold, SESSION_EVENTS, SESSION_STATE, "append", GroupStateTimeout.EventTimeTimeout)
