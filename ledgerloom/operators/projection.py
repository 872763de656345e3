"""Projecting captured records into a canonical table, and verifying what was projected.

Captured records have live_session_id, received_sequence, live_evidence_id,
event_record_id, provider_name, channel_name, machine_name, time_created_ts, observed_ts,
raw_xml, raw_xml_sha256, parser_raw_event_id, parsed_event_id and outcome. A projected row
has the canonical ``FIELDS`` with ``missing``, its identities, digests and place in the
capture's chain. The text of an entry and its order are fixed, so anyone can recompute it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import GENESIS, delete_permission, missing_fields, null_if_blank, parse_int64, parse_pid
from ledgerloom.operators.integrity import encoded, fold_hashes, payload_hash
from ledgerloom.operators.ordering import joined_with_nulls, numbered, numbered_with_before
from ledgerloom.operators.parse import parse_events
from ledgerloom.plans.scratch import written

#: Outcomes that are projected and the source that each stands for; fixed values.
SOURCES = {"delete_fact": "sysmon_delete", "process_context": "sysmon_process", "security_evidence": "security_4663"}
PROJECTABLE = tuple(SOURCES)
#: Names of the encodings that are hashed, and the order of the fields; fixed values.
PAYLOAD_V1, ENTRY_V1, EPOCH_V1 = "live-projection-payload-v1", "live-projection-entry-v1", "live-channel-epoch-v1"
FIELDS = (
    "source", "event_record_id", "provider_name", "channel_name", "machine_name", "event_ts", "observed_ts", "parser_raw_event_id", "parsed_event_id", "full_path",
    "object_kind", "process_id", "process_path", "process_guid", "command_line", "parent_process_id", "parent_process_path", "parent_process_guid", "user_name",
    "user_sid", "delete_permission", "archive_expected",
)
SEEN = ["live_session_id", "live_evidence_id", "received_sequence"]


def _instant(c: str) -> Column:
    """A UTC time with seven digits of a second, as it is hashed."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0+00:00'")


def evidence_id() -> Column:
    return F.concat_ws(":", "live_session_id", F.col("received_sequence").cast("string"))


def epoch_id(session: str = "live_session_id", channel: str = "channel_name", machine: str = "machine_name") -> Column:
    """A capture's span on a channel of a machine; a machine that is not known is not the one without a name."""
    return F.concat(F.lit("live-epoch:"), F.upper(F.sha2(encoded(F.lit(EPOCH_V1), F.col(session), F.col(channel), F.col(machine)), 256)))


def payload() -> Column:
    """The digest of a canonical row's fields and of the names of those that are missing."""
    text = {"event_ts": _instant("event_ts"), "observed_ts": _instant("observed_ts")}
    return payload_hash([F.lit(PAYLOAD_V1), *(text.get(c, F.col(c)) for c in FIELDS)], F.col("missing"))


def packed(text: Column) -> Column:
    """A text as bytes, its last 64 characters as 32 if they are hexadecimal digits of one case; different texts stay different."""
    short = lambda sign: F.concat(F.lit(sign), F.unhex(F.substring(text, -64, 64)), F.substring(text, F.lit(1), F.length(text) - 64).cast("binary"))
    return F.when(text.rlike(r"[0-9a-f]{64}\z"), short(b"\x01")).when(text.rlike(r"[0-9A-F]{64}\z"), short(b"\x02")).otherwise(F.concat(F.lit(b"\x00"), text.cast("binary")))


def dense_sequence(records: DataFrame) -> DataFrame:
    """Projectable records numbered without gaps per capture, in received order."""
    return numbered(records.where(F.col("outcome").isin(*PROJECTABLE)), ["live_session_id"], "received_sequence", "projected_sequence")


def canonicalize(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Captured records parsed anew: ``failure`` (null if there is none), the canonical fields, ids and digests, and the columns in ``keep``.

    Failures, the first that holds: live_evidence_identity_mismatch, source_digest_mismatch,
    source_outcome_not_projectable, source_reparse_failed, source_parser_identity_mismatch,
    source_classification_mismatch. Records that fail keep their identities only. A delete,
    a process and a security record each fill the fields that such a record has.
    """
    mine = records.select(*SEEN, *keep, "event_record_id", "provider_name", "channel_name", "machine_name", F.col("time_created_ts").alias("event_time"), "observed_ts", "parser_raw_event_id", "parsed_event_id", F.col("outcome").alias("stated"), "raw_xml", "raw_xml_sha256")
    own = {c: f"own_{c}" for c in ("provider_name", "channel_name", "machine_name")}
    parsed = parse_events(mine.withColumnsRenamed(own))
    source = F.lit(None).cast("string")
    for outcome, name in SOURCES.items():
        source = F.when(F.col("stated") == outcome, name).otherwise(source)
    field = lambda name: null_if_blank(F.col("data")[name])
    number = lambda name: parse_pid(F.col("data")[name])
    is_delete, is_process, is_security = (F.col("stated") == o for o in PROJECTABLE)
    permission = delete_permission(F.col("data")["accesslist"], parse_int64(F.col("data")["accessmask"]))
    failure = (
        F.when(~F.col("live_evidence_id").eqNullSafe(evidence_id()), "live_evidence_identity_mismatch")
        .when(~F.col("raw_xml_sha256").eqNullSafe(F.sha2("raw_xml", 256)), "source_digest_mismatch")
        .when(source.isNull(), "source_outcome_not_projectable")
        .when(F.col("parse_error").isNotNull(), "source_reparse_failed")
        .when(~(F.col("parser_raw_event_id").eqNullSafe(F.col("xml_sha256")) & F.col("parsed_event_id").eqNullSafe(F.col("event_id"))), "source_parser_identity_mismatch")
        .when((F.col("source") != source) | (is_security & (permission == "not_observed")), "source_classification_mismatch")
    )
    values = {
        "full_path": F.when(is_delete, field("targetfilename")).when(is_security, field("objectname")),
        "object_kind": F.when(is_delete, "unknown"),
        "process_id": number("processid"),
        "process_path": F.when(is_security, field("processname")).otherwise(field("image")),
        "process_guid": F.when(~is_security, field("processguid")),
        "command_line": F.when(is_process, field("commandline")),
        "parent_process_id": F.when(is_process, number("parentprocessid")),
        "parent_process_path": F.when(is_process, field("parentimage")),
        "parent_process_guid": F.when(is_process, field("parentprocessguid")),
        "user_name": F.when(is_security, field("subjectusername")).otherwise(field("user")),
        "user_sid": F.when(is_security, field("subjectusersid")),
        "delete_permission": F.when(is_security, permission).when(is_delete, "not_observed"),
        "archive_expected": F.when(is_delete, F.col("event_id") == 23),
    }
    # explode_outer of one element keeps what follows from parsing each text for every field anew
    rows = parsed.select(
        *SEEN, *keep, "event_record_id", *(F.col(o).alias(c) for c, o in own.items()), F.col("event_time").alias("event_ts"), "observed_ts", "parser_raw_event_id", "parsed_event_id", "raw_xml_sha256", "stated",
        F.explode_outer(F.array(F.struct(failure.alias("failure"), source.alias("source"), *(v.alias(n) for n, v in values.items())))).alias("c"),
    ).select("*", "c.*").drop("c")
    names = lambda **fields: missing_fields({n: F.col(c) if c else F.lit(None) for n, c in fields.items()})
    shared = {"processId": "process_id", "processPath": "process_path"}
    missing = (
        F.when(F.col("stated") == "delete_fact", names(fullPath="full_path", **shared, processGuid="process_guid", commandLine=None, parentProcess=None, userName="user_name", userSid=None, deletePermission=None))
        .when(F.col("stated") == "process_context", names(processId="process_id", processGuid="process_guid", processPath="process_path", commandLine="command_line", parentProcessId="parent_process_id", parentProcessPath="parent_process_path", parentProcessGuid="parent_process_guid", userName="user_name", userSid=None))
        .otherwise(names(objectPath="full_path", **shared, userName="user_name", userSid="user_sid"))
    )
    # so does it keep the names from being gathered anew for the digest
    return rows.select("*", F.explode_outer(F.array(F.array_sort(missing))).alias("missing")).select(
        *SEEN, *keep, "failure", *FIELDS, "missing", "raw_xml_sha256", payload().alias("payload_hash"), epoch_id().alias("epoch_id"),
        F.concat(F.lit("live-projection:"), "live_evidence_id").alias("projected_id"),
    )


def entry(previous: str, evidence: str, epoch: str, sequence: int, xml_sha256: str, payload: str) -> str:
    """The hash of a projected entry behind ``previous``; hashes are encoded in capitals."""
    data = b"".join(len(b).to_bytes(4, "big") + b for b in (x.encode() for x in (ENTRY_V1, previous.upper(), evidence, epoch, str(sequence), xml_sha256.upper(), payload.upper())))
    return hashlib.sha256(data).hexdigest()


def chained(rows: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """Canonical rows with previous_hash (null for a capture's first) and entry_hash; with ``tails`` (live_session_id, entry_hash) chains go on."""
    parts = ["live_evidence_id", "epoch_id", "projected_sequence", "raw_xml_sha256", "payload_hash"]
    folded = fold_hashes(rows, "live_session_id", "projected_sequence", parts, entry, tails)
    return folded.withColumn("previous_hash", F.when(F.col("projected_sequence") > 1, F.col("previous_hash")))


def canonical_rows(records: DataFrame) -> DataFrame:
    """The rows that the projectable records give, numbered without gaps.

    They are parsed once and written, as numbering reads them twice; the XML goes no further.
    """
    parsed = written(canonicalize(records.where(F.col("outcome").isin(*PROJECTABLE))), "canonical")
    return numbered(parsed, ["live_session_id"], "received_sequence", "projected_sequence")


def channel_epochs(rows: DataFrame) -> DataFrame:
    """Per capture, channel and machine (null is its own) the first record's sequence, provider and time, and the number of records."""
    opened = F.coalesce("event_ts", "observed_ts")
    return rows.groupBy("live_session_id", "channel_name", "machine_name").agg(
        F.min("received_sequence").alias("first_sequence"), F.min_by("provider_name", "received_sequence").alias("provider_name"),
        F.min_by(opened, "received_sequence").alias("opened_ts"), F.count("*").alias("records"),
    ).withColumn("epoch_id", epoch_id())


def join_projection_source(projected: DataFrame, records: DataFrame) -> DataFrame:
    """Projected rows with whether their source record is there and still has the same XML."""
    source = records.select("live_evidence_id", F.col("raw_xml_sha256").alias("source_sha256"))
    state = F.when(F.col("source_sha256").isNull(), "missing_source").when(F.col("source_sha256") != F.col("raw_xml_sha256"), "changed_source").otherwise("ok")
    return projected.join(source, "live_evidence_id", "left").withColumn("source_state", state)


def verify_continuity(projected: DataFrame, records: DataFrame, epochs: DataFrame, runs: DataFrame) -> DataFrame:
    """(live_session_id, verified, first_break, evidence, reason): per capture the first place where what is stored does not follow from its records.

    Reasons per row, the first that holds: sequence_not_dense, missing_source,
    source_identity_mismatch, a failure of ``canonicalize``, identity_mismatch,
    payload_mismatch, digest_mismatch, previous_hash_mismatch, entry_hash_mismatch,
    epoch_missing, epoch_identity_mismatch, epoch_first_record_mismatch. For a capture without
    such a row: tail_cut (a completed run had considered more rows) and orphan_epoch. All rows
    are judged in parallel; the least place is the one that a walk would stop at.

    Either side is reduced to digests before it is shuffled. What a reason would compare with the
    record's values is worked out from the stored ones, where reasons before it have found them equal.
    """
    key = ["live_session_id"]
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    # times are compared beside the payload's text, which has no era
    content = F.sha2(encoded(F.col("own"), F.col("event_ts"), F.col("observed_ts")), 256)
    fresh = canonicalize(records).withColumn("own", F.col("payload_hash")).select(
        "live_evidence_id", *(F.col(c).alias(f"c_{c}") for c in ("live_session_id", "received_sequence", "failure", "channel_name", "machine_name")),
        packed(content).alias("c_content"), F.lit(True).alias("found"),
    )
    capital = lambda c: F.upper(c)
    fields = (F.lit(ENTRY_V1), capital(F.coalesce("previous_hash", F.lit(GENESIS))), F.col("live_evidence_id"), F.col("epoch_id"), F.col("projected_sequence"), capital("raw_xml_sha256"), capital("own"))
    # names of missing fields are sorted in what a record gives, and hashed as sorted
    mine = projected.withColumn("own", F.when(F.col("missing") == F.array_sort("missing"), payload())).select(
        *SEEN, "projected_sequence", packed(F.col("epoch_id")).alias("epoch"), packed(F.when(F.col("own").isNotNull(), content)).alias("content"),
        packed(F.col("previous_hash")).alias("previous"), packed(F.col("entry_hash")).alias("entry"), "provider_name", F.coalesce("event_ts", "observed_ts").alias("opened"),
        F.col("projected_id").eqNullSafe(F.concat(F.lit("live-projection:"), "live_evidence_id")).alias("named"),
        # a record that does not fail has its XML's digest as its parser's id, which is one of the fields
        (same("payload_hash", "own") & same("raw_xml_sha256", "parser_raw_event_id")).alias("hashed"),
        F.col("entry_hash").eqNullSafe(F.sha2(encoded(*fields), 256)).alias("follows"),
    )
    placed = numbered_with_before(mine, key, "projected_sequence", "place", "entry", "before")
    chained_to = F.col("previous").eqNullSafe(F.when(F.col("place") > 1, F.col("before")))
    placed = placed.withColumn("late", F.when(~chained_to, "previous_hash_mismatch").when(~F.col("follows"), "entry_hash_mismatch")).drop("previous", "entry", "before", "follows")
    first = F.struct("place", "provider_name", "received_sequence", "opened")
    own_epochs = placed.groupBy(*key, "epoch").agg(F.count("*").alias("rows"), F.min_by(first, "place").alias("first"), F.max(F.struct("place", "live_evidence_id")).alias("last"))
    rows = placed.drop("provider_name", "opened").join(fresh, "live_evidence_id", "left")
    reason = (
        F.when(F.col("projected_sequence") != F.col("place"), "sequence_not_dense")
        .when(F.col("found").isNull(), "missing_source")
        .when(~(same("live_session_id", "c_live_session_id") & same("received_sequence", "c_received_sequence")), "source_identity_mismatch")
        .when(F.col("c_failure").isNotNull(), F.col("c_failure"))
        .when(~(F.col("named") & F.col("epoch").eqNullSafe(packed(epoch_id("c_live_session_id", "c_channel_name", "c_machine_name")))), "identity_mismatch")
        .when(~same("content", "c_content"), "payload_mismatch")
        .when(~F.col("hashed"), "digest_mismatch")
        .otherwise(F.col("late"))
    )
    at = lambda reason: F.struct("place", "live_evidence_id", reason.alias("reason"))
    found = rows.withColumn("reason", reason).groupBy(*key, "epoch").agg(
        F.min(F.when(F.col("reason").isNotNull(), at(F.col("reason")))).alias("bad"), F.min(F.when(F.col("reason").isNull(), F.struct("place", "live_evidence_id"))).alias("good")
    )
    # a sound row's epoch is the digest of its capture, channel and machine, so whether the stored epoch has the same ones shows in its own id
    known = epochs.select(
        *key, packed(F.col("epoch_id")).alias("epoch"), F.struct("provider_name", "first_sequence", "opened_ts", F.col("epoch_id").eqNullSafe(epoch_id()).alias("named")).alias("stored")
    )
    first_record = F.col("stored.provider_name").eqNullSafe(F.col("first.provider_name")) & (F.col("stored.first_sequence") == F.col("first.received_sequence")) & F.col("stored.opened_ts").eqNullSafe(F.col("first.opened"))
    epoch_reason = (
        F.when(F.col("stored").isNull(), "epoch_missing").when(~F.col("stored.named"), "epoch_identity_mismatch")
        .when((F.col("good.place") == F.col("first.place")) & ~first_record, "epoch_first_record_mismatch")
    )
    broken = F.when(F.col("good").isNotNull() & epoch_reason.isNotNull(), F.struct("good.place", "good.live_evidence_id", epoch_reason.alias("reason")))
    by_epoch = joined_with_nulls(own_epochs, found, [*key, "epoch"]).join(known, [*key, "epoch"], "left")
    judged = by_epoch.groupBy(*key).agg(F.sum("rows").alias("rows"), F.min(F.least("bad", broken)).alias("at"), F.max("last").alias("last"))
    judged = judged.select(*key, "rows", F.col("at.place").alias("first_bad"), "at", F.col("last.live_evidence_id").alias("last_id"))
    orphans = epochs.join(projected.select(*key, "epoch_id").distinct(), [*key, "epoch_id"], "left_anti").groupBy(*key).agg(F.count("*").alias("orphans"))
    every = records.select(*key).distinct().unionAll(projected.select(*key).distinct()).unionAll(epochs.select(*key)).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    state = every.join(judged, key, "left").join(orphans, key, "left").join(projection_high_water(runs), key, "left").withColumns(
        {"rows": zero("rows"), "orphans": zero("orphans"), "high_water": zero("high_water")}
    )
    whole = F.when(F.col("high_water") > F.col("rows"), "tail_cut").when(F.col("orphans") > 0, "orphan_epoch")
    first = F.coalesce("first_bad", F.when(whole.isNotNull(), F.col("rows") + 1))
    return state.select(
        *key, F.coalesce(F.col("first_bad") - 1, F.col("rows")).alias("verified"), first.alias("first_break"),
        F.when(F.col("first_bad").isNotNull(), F.col("at.live_evidence_id")).when(whole.isNotNull(), F.col("last_id")).alias("evidence"), F.coalesce("at.reason", whole).alias("reason"),
    )


def ledger_check(completions: DataFrame, records: DataFrame) -> DataFrame:
    """Captures whose completion states another number of records than is stored."""
    stored = records.groupBy("live_session_id").agg(F.count("*").alias("stored"))
    joined = completions.join(stored, "live_session_id", "left").withColumn("stored", F.coalesce("stored", F.lit(0)).cast("long"))
    return joined.where("persisted <> stored").select("live_session_id", "persisted", "stored")


def projection_high_water(runs: DataFrame) -> DataFrame:
    """Per capture the most records that a completed run considered; 0 if none was completed."""
    done = F.max(F.when(F.col("completed"), F.col("considered")))
    return runs.groupBy("live_session_id").agg(F.coalesce(done, F.lit(0)).cast("long").alias("high_water"))


def project_session(records: DataFrame, completions: DataFrame, projected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to append, run rows): what is not projected yet of each capture that is complete.

    A capture is refused (its run says why, and none of its rows is returned) if it has no
    completion, if its completion states another number of records than is stored, if one of
    its records fails (see ``canonicalize``; the first failure is named), or if stored rows
    are not an exact beginning of what its records give. Running again appends nothing; the
    rows that are appended go on with the stored chain.
    """
    stored = records.groupBy("live_session_id").agg(F.count("*").alias("stored"), F.count_if(F.col("outcome").isin(*PROJECTABLE)).alias("considered"))
    rows = canonical_rows(records)
    if projected is None:
        projected = chained(rows.limit(0).drop("failure"))
    old = projected.select("live_session_id", "projected_sequence", F.col("projected_id").alias("old_id"), F.col("payload_hash").alias("old_hash"))
    both = old.join(rows.select("live_session_id", "projected_sequence", "projected_id", "payload_hash"), ["live_session_id", "projected_sequence"], "left")
    same = F.coalesce((F.col("old_id") == F.col("projected_id")) & (F.col("old_hash") == F.col("payload_hash")), F.lit(False))
    kept = both.groupBy("live_session_id").agg(F.count("*").alias("already"), F.max("projected_sequence").alias("last"), F.count_if(~same).alias("different"))
    failed = F.when(F.col("failure").isNotNull(), F.col("received_sequence"))
    failures = rows.groupBy("live_session_id").agg(F.min_by("failure", failed).alias("failure"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    state = stored.join(completions.select("live_session_id", "persisted"), "live_session_id", "left").join(kept, "live_session_id", "left").join(failures, "live_session_id", "left")
    refusal = (
        F.when(F.col("persisted").isNull(), "incomplete_capture").when(F.col("persisted") != F.col("stored"), "ledger_mismatch").when(F.col("failure").isNotNull(), F.col("failure"))
        .when((zero("different") > 0) | (zero("already") != zero("last")), "stored_rows_are_no_prefix")
    )
    runs = state.select(
        "live_session_id", "considered", zero("already").alias("already"), refusal.alias("refusal"),
        F.when(refusal.isNull(), F.col("considered") - zero("already")).otherwise(0).alias("appended"), refusal.isNull().alias("completed"),
    )
    accepted = runs.where("completed").select("live_session_id", "already")
    fresh = rows.drop("failure").join(accepted, "live_session_id").where(F.col("projected_sequence") > F.col("already")).drop("already")
    tails = projected.groupBy("live_session_id").agg(F.max_by("entry_hash", "projected_sequence").alias("entry_hash"))
    return chained(fresh, tails.join(accepted.select("live_session_id"), "live_session_id", "left_semi")), runs
