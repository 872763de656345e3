"""Column functions of the audit rules. Case is folded with ``lower``/``upper`` throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.options import ProtectedRule

BACKSLASH = "\\"
GENESIS = "0" * 64
DELETE_MASK, DELETE_CHILD_MASK = 0x10000, 0x40


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without time zone."""
    name = ts if isinstance(ts, str) else None
    column = F.col(name) if name else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column.cast("timestamp_ntz"))


def null_if_blank(c: Column) -> Column:
    """Trimmed text; null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def normalize_path(c: Column) -> Column:
    """Trimmed, with backslashes only, and without those at the end if longer than a drive's root."""
    text = F.replace(F.trim(c), F.lit("/"), F.lit(BACKSLASH))
    return F.when(F.length(text) > 3, F.regexp_replace(text, r"\\+$", "")).otherwise(text)


def parent_path(c: Column) -> Column:
    """The folder of a path; what lies right in a drive's root is its own scope. Null for blank."""
    text = F.regexp_replace(F.replace(F.trim(c), F.lit("/"), F.lit(BACKSLASH)), r"\\+$", "")
    folder = F.regexp_extract(text, r"^(.*)\\[^\\]*$", 1)
    return F.when(F.trim(c) == "", None).when(F.length(folder) > 2, folder).otherwise(text)


def path_kind(c: Column) -> Column:
    """device_namespace, network_share, local_fully_qualified or other, from the text alone."""
    return (
        F.when(F.coalesce(F.trim(c), F.lit("")) == "", "other")
        .when(c.rlike(r"^[\\/][\\/][?.][\\/]|^[\\/]\?\?[\\/]"), "device_namespace")
        .when(c.rlike(r"^[\\/][\\/][^\\/]"), "network_share")
        .when(c.rlike(r"^[A-Za-z]:[\\/]|^[\\/][\\/]"), "local_fully_qualified")
        .otherwise("other")
    )


def parse_int64(c: Column) -> Column:
    """Decimal or 0x-hexadecimal number; null for anything else and beyond 64 bits."""
    text = F.trim(c)
    digits = F.regexp_extract(text, r"^0[xX]0*([0-9A-Fa-f]{1,16})$", 1)
    return F.when(digits != "", F.conv(digits, 16, -10).cast("long")).when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))


def parse_pid(c: Column) -> Column:
    n = parse_int64(c)
    return F.when((n >= 0) & (n <= 2147483647), n.cast("int"))


def event_source(provider: Column, event_id: Column) -> Column:
    """Which kind of event a provider and id make."""
    name = F.lower(provider)
    return (
        F.when((name == "microsoft-windows-sysmon") & event_id.isin(23, 26), "sysmon_delete")
        .when((name == "microsoft-windows-sysmon") & (event_id == 1), "sysmon_process")
        .when((name == "microsoft-windows-security-auditing") & (event_id == 4663), "security_4663")
        .otherwise("unsupported")
    )


def event_data_map(pairs: Column) -> Column:
    """Map of an array of (name, value): names in lower case, blank ones dropped, of equal ones the first."""
    named = F.filter(F.transform(pairs, lambda p: F.struct(F.lower(null_if_blank(p["name"])).alias("k"), p["value"].alias("v"))), lambda p: p["k"].isNotNull())
    names = F.transform(named, lambda q: q["k"])
    first = F.filter(named, lambda p, i: F.array_position(names, p["k"]) == i + 1)
    # names seldom repeat, and only then is each looked up among all
    return F.map_from_entries(F.when(F.size(F.array_distinct(names)) == F.size(names), named).otherwise(first))


def event_data_warnings(pairs: Column) -> Column:
    """What ``event_data_map`` leaves out of an array of (name, value), in order: ``blank_name``, or ``duplicate_name:`` and the name in lower case."""
    names = F.transform(pairs, lambda p: F.lower(null_if_blank(p["name"])))
    warning = lambda n, i: F.when(n.isNull(), "blank_name").when(F.array_position(names, n) <= i, F.concat(F.lit("duplicate_name:"), n))
    found = F.filter(F.transform(names, warning), lambda w: w.isNotNull())
    plain = ~F.exists(names, lambda n: n.isNull()) & (F.size(F.array_distinct(names)) == F.size(names))
    return F.when(plain, F.array().cast("array<string>")).otherwise(found)


def delete_permission(access_list: Column, access_mask: Column) -> Column:
    """delete, delete_child, delete_and_delete_child or not_observed, from the mask's bits or the list's tokens."""
    listed = F.coalesce(access_list, F.lit(""))
    mask = F.coalesce(access_mask, F.lit(0))
    own = (mask.bitwiseAND(DELETE_MASK) != 0) | listed.rlike(r"(?i)%%1537|(?<![A-Z_])DELETE(?![A-Z_])")
    child = (mask.bitwiseAND(DELETE_CHILD_MASK) != 0) | listed.rlike(r"(?i)%%4424|DELETE[_ ]?CHILD")
    return F.when(own & child, "delete_and_delete_child").when(own, "delete").when(child, "delete_child").otherwise("not_observed")


def missing_fields(fields: dict[str, Column]) -> Column:
    """Names of the fields whose column is null, in the given order."""
    return F.filter(F.array(*(F.when(c.isNull(), F.lit(n)) for n, c in fields.items())), lambda x: x.isNotNull())


def process_identity(guid: Column, computer: Column, pid: Column, raw_id: Column) -> Column:
    return F.coalesce(
        F.when(F.trim(guid) != "", F.concat(F.lit("guid:"), F.upper(guid))),
        F.when(F.trim(computer) != "", F.concat(F.lit("pid:"), F.upper(computer), F.lit(":"), pid.cast("string"))),
        F.concat(F.lit("unknown:"), raw_id),
    )


def user_identity(sid: Column, name: Column, raw_id: Column) -> Column:
    return F.coalesce(
        F.when(F.trim(sid) != "", F.concat(F.lit("sid:"), F.upper(sid))),
        F.when(F.trim(name) != "", F.concat(F.lit("name:"), F.upper(name))),
        F.concat(F.lit("unknown:"), raw_id),
    )


def stable_id(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by U+001F; nulls are told from empty texts."""
    columns = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("<null>")) for p in parts]
    return F.sha2(F.concat_ws("\u001f", *columns), 256)


def contains_ci(c: Column, text: str | None) -> Column:
    """Literal search without regard to case; blank text finds everything."""
    wanted = (text or "").strip()
    return F.lower(c).contains(wanted.lower()) if wanted else F.lit(True)


def time_range(c: Column, begin: str | None = None, end: str | None = None) -> Column:
    """``begin <= c < end``; an absent bound is open."""
    if begin is not None and end is not None and begin >= end:
        raise ValueError("the range must begin before it ends")
    ok = F.lit(True)
    if begin is not None:
        ok = ok & (c >= F.lit(begin).cast("timestamp_ntz"))
    return ok & (c < F.lit(end).cast("timestamp_ntz")) if end is not None else ok


def protected_root(path: Column, rules: Sequence[ProtectedRule]) -> Column:
    """Path of the first enabled rule that the path equals or lies under; null if none."""
    own = F.lower(normalize_path(path))
    found = None
    for rule in (r for r in rules if r.enabled):
        root = F.lower(normalize_path(F.lit(rule.path)))
        hit = (own == root) | own.startswith(F.concat(root, F.lit(BACKSLASH)))
        found = F.when(hit, rule.path) if found is None else found.when(hit, rule.path)
    return F.lit(None).cast("string") if found is None else found
