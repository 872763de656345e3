"""The process and the security evidence behind each delete: a ladder of nearest-in-time matches.

No match makes pairs. Every rule is an equality of keys, so a delete and its possible partners
are given one row per rule with that rule's key and sorted into one order per key and hour, in
which each delete sees the nearest partner before and after it; a row per hour carries the
nearest ones across hours. A key that holds a third of all rows is spread over its hours, and
the rows within one are sorted, not multiplied. The candidates of a delete, at most one a
rule, meet in one aggregation with partial minima, which carries the partner's fields along;
ties go to the earlier record.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import micros, missing_fields, normalize_path
from ledgerloom.operators.ordering import following, nearest
from ledgerloom.options import HOUR, CorrelationOptions

#: Fields that a process or evidence may fill, with their names in reasons, in order.
PROCESS_FIELDS = {
    "command_line": "commandLine", "parent_process_id": "parentProcessId", "parent_process_path": "parentProcessPath",
    "parent_process_guid": "parentProcessGuid", "user_name": "userName", "user_sid": "userSid",
}
SECURITY_FIELDS = {"user_name": "userName", "user_sid": "userSid"}


def _known(c: Column) -> Column:
    """Folded text that may be compared; null for blank."""
    return F.lower(F.when(F.trim(c) != "", c))


def _path_key(c: Column) -> Column:
    return F.lower(normalize_path(F.when(F.trim(c) != "", c)))


def _user_keys(prefix: str) -> dict[str, Column]:
    """Keys of which exactly one can be equal if two sides have the same user: equal SIDs if both have one, else equal names."""
    sid, name = _known(F.col(f"{prefix}_sid")), _known(F.col(f"{prefix}_user"))
    if prefix == "d":
        return {"sid": sid, "name_without_sid": F.when(sid.isNotNull(), name), "name": F.when(sid.isNull(), name)}
    return {"sid": sid, "name_without_sid": F.when(sid.isNull(), name), "name": name}


def _side(df: DataFrame, prefix: str, object_path: str | None = None, fields: Sequence[str] = ()) -> DataFrame:
    optional = lambda name, kind: F.col(name) if name in df.columns else F.lit(None).cast(kind)
    return df.select(
        F.col("raw_event_id").alias(f"{prefix}_id"),
        F.col("record_ordinal").alias(f"{prefix}_ord"),
        _known(F.col("computer_name")).alias("computer"),
        F.col("process_id").alias("pid"),
        micros("occurred_ts").alias(f"{prefix}_us"),
        _known(optional("process_guid", "string")).alias("guid"),
        _path_key(F.col(object_path or "process_path")).alias("path"),
        F.col("user_name").alias(f"{prefix}_user"),
        F.col("user_sid").alias(f"{prefix}_sid"),
        *([F.struct(*fields).alias(f"{prefix}_fields")] if fields else []),
    )


def _nearest(candidates: DataFrame, name: str) -> DataFrame:
    """(d_id, name: struct of partner id and distance) for the nearest candidate of each delete."""
    best = F.min_by(F.struct(F.col("partner").alias("id"), "delta"), F.struct("delta", "ordinal"))
    return candidates.groupBy("d_id").agg(best.alias(name))


def _keyed(side: DataFrame, prefix: str, tiers: Sequence[int], security: bool) -> DataFrame:
    """A row per rule for which the side's row has a whole key: tier, pid, text and user, the rule's parts."""

    def key(tier: int, text: Column, pid: Column | None = None, user: Column | None = None) -> Column:
        parts = [c for c in (text, pid, user) if c is not None]
        whole = reduce(lambda a, b: a & b, (c.isNotNull() for c in parts))
        value = F.struct(F.lit(tier).alias("tier"), text.alias("text"), (F.lit(-1) if pid is None else pid).cast("long").alias("pid"), (F.lit("") if user is None else user).alias("user"))
        return F.when(whole, value)

    def of_user(text: Column) -> list[Column]:
        return [key(2, F.concat(F.lit(f"{rule}:"), text), F.col("pid"), user) for rule, user in _user_keys(prefix).items()]

    rules = {1: [key(1, F.col("path"))], 2: of_user(F.col("path") if security else F.lit("")), 3: [key(3, F.col("guid"))]}
    keys = F.array_compact(F.array(*(k for t in tiers for k in rules[t])))
    return side.where("computer IS NOT NULL").withColumn("_key", F.explode(keys)).drop("pid").select("*", "_key.*").drop("_key", "guid", "path")


def _matched(d: DataFrame, other: DataFrame, prefix: str, kind: str, tiers: Sequence[int], window_us: int) -> DataFrame:
    """(d_id, kind, tier, delta, ordinal, partner, and fields if the side carries them): the nearest partner by each rule."""
    extra = [c for c in (f"{prefix}_fields", "next_start") if c in other.columns]
    value = F.struct(f"{prefix}_id", f"{prefix}_us", f"{prefix}_ord", *extra)
    left = _keyed(d, "d", tiers, kind == "security").select("computer", "tier", "text", "pid", "user", "d_id", "d_us")
    right = _keyed(other, prefix, tiers, kind == "security")
    sides = nearest(left, right, ["computer", "tier", "text", "pid", "user"], ("d_us", f"{prefix}_us"), value, f"{prefix}_ord", HOUR)

    def candidate(side: str) -> Column:
        x = F.col(side)
        delta = F.abs(F.col("d_us") - x[f"{prefix}_us"])
        near = x.isNotNull() & ((F.col("tier") == 3) | (delta <= window_us))
        if "next_start" in extra:  # the last start before a delete is the only one that can have lived until then
            near = near & ((F.col("tier") != 2) | x["next_start"].isNull() | (x["next_start"] > F.col("d_us")))
        fields = [x[f"{prefix}_fields"].alias("fields")] if f"{prefix}_fields" in extra else []
        return F.when(near, F.struct(delta.alias("delta"), x[f"{prefix}_ord"].alias("ordinal"), x[f"{prefix}_id"].alias("partner"), *fields))

    best = F.array_min(F.array_compact(F.array(candidate("before"), candidate("after"))))
    return sides.select("d_id", F.lit(kind).alias("kind"), "tier", best.alias("best")).where("best IS NOT NULL").select("d_id", "kind", "tier", "best.*")


def process_candidates(d: DataFrame, p: DataFrame, window_us: int, tiers: Sequence[int] = (3, 2, 1)) -> DataFrame:
    """The nearest process by each rule: same computer and GUID at any distance (3); same computer,
    process id and user within the window, unless the id was started anew by then (2); same
    computer and path within the window, a hint only (1)."""
    return _matched(d, with_next_start(p) if 2 in tiers else p, "p", "process", tiers, window_us)


def security_candidates(d: DataFrame, s: DataFrame, window_us: int) -> DataFrame:
    """The nearest evidence of the same computer and object within the window: of the same process and user (2), of any (1)."""
    return _matched(d, s, "s", "security", (2, 1), window_us)


def match_process_guid(deletes: DataFrame, processes: DataFrame) -> DataFrame:
    return _nearest(process_candidates(_side(deletes, "d"), _side(processes, "p"), 0, (3,)), "by_guid")


def with_next_start(side: DataFrame) -> DataFrame:
    """Adds when the same process id was next started, later than this, on the same computer; null for rows without either."""
    key = ["computer", "pid"]
    known = side.where("computer IS NOT NULL AND pid IS NOT NULL").select(*key, "p_us").distinct()
    return side.join(following(known, key, "p_us", "next_start", HOUR), [*key, "p_us"], "left")


def match_process_pid(deletes: DataFrame, processes: DataFrame, options: CorrelationOptions) -> DataFrame:
    return _nearest(process_candidates(_side(deletes, "d"), _side(processes, "p"), options.window_us, (2,)), "by_pid")


def match_process_path(deletes: DataFrame, processes: DataFrame, options: CorrelationOptions) -> DataFrame:
    return _nearest(process_candidates(_side(deletes, "d"), _side(processes, "p"), options.window_us, (1,)), "by_path")


def newest_of_guid(processes: DataFrame) -> DataFrame:
    """Of each computer and GUID the newest process (of equal times the first), all that a match by GUID needs of those before every delete."""
    own = F.struct(*processes.columns)
    known = processes.withColumns({"_computer": _known(F.col("computer_name")), "_guid": _known(F.col("process_guid"))}).where("_computer IS NOT NULL AND _guid IS NOT NULL")
    newest = known.groupBy("_computer", "_guid").agg(F.min_by(own, F.struct(-micros("occurred_ts"), F.col("record_ordinal"))).alias("row"))
    return newest.select("row.*")


def permitted(evidence: DataFrame) -> DataFrame:
    return evidence.where("delete_permission <> 'not_observed'")


def match_security(deletes: DataFrame, evidence: DataFrame, options: CorrelationOptions) -> DataFrame:
    """(d_id, reliable, hint): the nearest evidence of each kind."""
    found = security_candidates(_side(deletes, "d", "full_path"), _side(permitted(evidence), "s", "full_path"), options.window_us)
    value, order = F.struct(F.col("partner").alias("id"), "delta"), F.struct("delta", "ordinal")
    reliable = F.col("tier") == 2
    return found.groupBy("d_id").agg(F.min_by(F.when(reliable, value), F.when(reliable, order)).alias("reliable"), F.min_by(value, order).alias("hint"))


def trim_candidates(pairs: DataFrame, keep: int = 512, limit_us: int | None = None) -> DataFrame:
    """Of (d_id, kind, delta, ordinal, ...) the ``keep`` nearest per delete and kind, none farther than ``limit_us``."""
    near = pairs if limit_us is None else pairs.where(F.col("delta") <= limit_us)
    order = Window.partitionBy("d_id", "kind").orderBy("delta", "ordinal")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).drop("place")


def _merged(own: Column, candidate: Column, use: Column, name: str) -> tuple[Column, Column]:
    """The merged value and the reason, if there is one; the comparison minds case."""
    reason = F.when(
        use & candidate.isNotNull(),
        F.when(own.isNull(), F.lit(f"enriched:{name}")).when(own != candidate, F.lit(f"conflict_preserved_original:{name}")),
    )
    return F.coalesce(own, F.when(use, candidate)), reason


def correlate(
    deletes: DataFrame, processes: DataFrame, evidence: DataFrame, options: CorrelationOptions = CorrelationOptions(), allowed: DataFrame | None = None
) -> DataFrame:
    """Each delete with its best match, both matched ids, merged fields, reasons and what is still missing.

    With ``allowed`` (d_id, partner) no other partners count, as in the analysis of a live
    capture; it holds the nearest ones, so the nearest by a rule is among them or none is.
    """
    present = [f for f in PROCESS_FIELDS if f in processes.columns]
    own = deletes
    for f in present:
        if f not in own.columns:
            own = own.withColumn(f, F.lit(None).cast(processes.schema[f].dataType))
    window = options.window_us
    d, p = _side(deletes, "d"), _side(processes, "p", fields=present)
    s = _side(permitted(evidence), "s", "full_path", [*SECURITY_FIELDS, "delete_permission"])
    of_process = process_candidates(d, p, window)
    of_security = security_candidates(_side(deletes, "d", "full_path"), s, window)
    absent = lambda df, name: F.lit(None).cast(df.schema[name].dataType)
    union = of_process.withColumnRenamed("fields", "p_fields").withColumn("s_fields", absent(of_security, "fields")).unionByName(
        of_security.withColumnRenamed("fields", "s_fields").withColumn("p_fields", absent(of_process, "fields"))
    )
    if allowed is not None:
        union = union.join(allowed, ["d_id", "partner"], "left_semi")
    order = F.struct(-F.col("tier"), "delta", "ordinal")
    best = lambda kind, fields: F.min_by(F.struct(F.col("partner").alias("id"), "delta", "tier", F.col(fields).alias("fields")), F.when(F.col("kind") == kind, order))
    matches = union.groupBy("d_id").agg(best("process", "p_fields").alias("process"), best("security", "s_fields").alias("security"))
    joined = own.join(matches.withColumnRenamed("d_id", "raw_event_id"), "raw_event_id", "left").withColumns(
        {
            "process_raw_id": F.col("process.id"), "security_raw_id": F.col("security.id"), "process_rank": F.col("process.tier"), "security_rank": F.col("security.tier"),
            **{f"p_{f}": F.col(f"process.fields.{f}") for f in present}, **{f"s_{f}": F.col(f"security.fields.{f}") for f in SECURITY_FIELDS},
            "s_permission": F.col("security.fields.delete_permission"),
        }
    )
    by_process, by_security = F.coalesce(F.col("process_rank") >= 2, F.lit(False)), F.coalesce(F.col("security_rank") == 2, F.lit(False))
    values = {f: F.col(f) for f in present}
    reasons: list[Column] = []
    for f in present:
        values[f], reason = _merged(values[f], F.col(f"p_{f}"), by_process, PROCESS_FIELDS[f])
        reasons.append(reason)
    reasons.append(F.when(F.col("process_rank") == 1, "path_time_match_retained_as_non_authoritative_candidate"))
    for f, name in SECURITY_FIELDS.items():
        values[f], reason = _merged(values[f], F.col(f"s_{f}"), by_security, name)
        reasons.append(reason)
    reasons.append(F.when(F.col("security_rank") == 1, "security_path_time_match_retained_as_non_authoritative_candidate"))
    reasons.append(F.when(F.col("process_rank").isNull() & F.col("security_rank").isNull(), "no_reliable_match"))
    first = F.coalesce("process_rank", F.lit(0)) >= F.coalesce("security_rank", F.lit(0))  # on a tie the process counts
    rank = F.greatest(F.coalesce("process_rank", F.lit(0)), F.coalesce("security_rank", F.lit(0)))
    delta = F.when(first, F.col("process.delta")).otherwise(F.col("security.delta"))
    permission = F.when(by_security, F.col("s_permission")).otherwise(F.col("delete_permission"))
    out = joined.select(
        "raw_event_id",
        "record_ordinal",
        F.element_at(F.array(*map(F.lit, ("none", "path_and_time_heuristic", "device_pid_user_and_time", "process_guid"))), rank + 1).alias("method"),
        F.element_at(F.array(*map(F.lit, ("none", "low", "medium", "high"))), rank + 1).alias("confidence"),
        F.floor((delta + 500) / 1000).alias("delta_ms"),
        "process_raw_id",
        "security_raw_id",
        (by_process | by_security).alias("identity_enriched"),
        *(v.alias(f) for f, v in values.items()),
        permission.alias("permission"),
        F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("reasons"),
        "full_path", "process_id", "process_path", "process_guid",
    )
    parents = [F.col(f) for f in present if f.startswith("parent_")]
    fields = {
        "fullPath": F.col("full_path"), "processId": F.col("process_id"), "processPath": F.col("process_path"), "processGuid": F.col("process_guid"),
        "commandLine": F.col("command_line"), "parentProcess": F.coalesce(*parents) if parents else F.lit(None),
        "userName": F.col("user_name"), "userSid": F.col("user_sid"), "deletePermission": F.nullif("permission", F.lit("not_observed")),
    }
    return out.withColumn("missing", missing_fields(fields)).drop("full_path", "process_id", "process_path", "process_guid")


def attach_evidence_ids(correlated: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds the live evidence ids of the matched raw events; ``ids`` is (raw_event_id, live_evidence_id)."""
    of = lambda name: ids.select(F.col("raw_event_id").alias(f"{name}_raw_id"), F.col("live_evidence_id").alias(f"{name}_evidence_id"))
    return correlated.join(of("process"), "process_raw_id", "left").join(of("security"), "security_raw_id", "left")
