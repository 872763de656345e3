"""Deduplication, gaps, caps and contract checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ordering import following, numbered

#: Spellings of a diagnostic's stage and the stored one; fixed values. Any other is ``persist``.
STAGES = {
    "source_validation": "source_validation", "validation": "source_validation", "source_read": "read", "read": "read", "record_extract": "extract",
    "source_extract": "extract", "extract": "extract", "xml_parse": "parse", "parse": "parse", "normalization": "normalize", "normalize": "normalize",
    "correlation": "correlate", "correlate": "correlate", "persistence": "persist", "persist": "persist", "jsonl": "jsonl", "manifest": "manifest",
}

def first_in_input(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key the first; the others are dropped."""
    first = Window.partitionBy(key).orderBy(order)
    return df.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")


def new_rows(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet."""
    return df.join(existing.select(key), key, "left_anti")


def known_rows(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is stored already."""
    return df.join(existing.select(key), key, "left_semi")


def dedupe_raw(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Each new raw event with the id it is kept under.

    An event is known by its id, or else by computer, channel epoch and record id; two
    equi-joins, the first taking precedence, stand for the OR.
    """
    by_id = existing.select("raw_event_id").distinct().withColumn("same_id", F.col("raw_event_id"))
    natural = ["computer_name", "epoch_id", "record_id"]
    by_record = existing.groupBy(*natural).agg(F.min("raw_event_id").alias("same_record"))
    kept = F.coalesce("same_id", "same_record", "raw_event_id")
    return new.join(by_id, "raw_event_id", "left").join(by_record, natural, "left").select(
        *new.columns, kept.alias("kept_id"), F.coalesce("same_id", "same_record").isNull().alias("is_new")
    )


def sequence_gaps(df: DataFrame, session: str = "live_session_id", sequence: str = "received_sequence") -> DataFrame:
    """(session, after, missing): where received sequence numbers are missing and how many."""
    rows = following(df.select(session, sequence), [session], sequence, "next")
    return rows.select(session, F.col(sequence).alias("after"), (F.col("next") - F.col(sequence) - 1).alias("missing")).where("missing > 0")


def cap_diagnostics(df: DataFrame, keep: int = 256, cut: int = 2048) -> tuple[DataFrame, DataFrame]:
    """The first ``keep`` diagnostics of each capture with messages cut, and per capture how many more there were."""
    placed = numbered(df, ["live_session_id"], "received_sequence", "place")
    kept = placed.where(F.col("place") <= keep).withColumn("message", F.substring("message", 1, cut)).drop("place")
    surplus = df.groupBy("live_session_id").agg(F.greatest(F.count("*") - keep, F.lit(0)).alias("surplus"))
    return kept, surplus


def stored_stage(stage: Column) -> Column:
    """The spelling under which a diagnostic's stage is stored."""
    spelt = F.lower(F.trim(stage))
    out = F.lit("persist")
    for spelling, stored in STAGES.items():
        out = F.when(spelt == spelling, stored).otherwise(out)
    return out


def collect_diagnostics(*parts: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """All diagnostics; of those equal in record, stage, severity, code and message the first of the first part.

    With ``records`` (import_session_id, record_number) a number that the import does not
    have becomes null and is kept in ``details_json``, as is a stage that is stored under
    another name.
    """
    union = reduce(lambda a, b: a.unionByName(b), (p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)))
    unmatched = F.lit(None).cast("long")
    if records is not None:
        known = records.select("import_session_id", "record_number").distinct().withColumn("known", F.lit(True))
        union = union.join(known, ["import_session_id", "record_number"], "left")
        unmatched = F.when(F.col("known").isNull(), F.col("record_number"))
    union = union.withColumn("unmatched", unmatched).withColumn("record_number", F.when(F.col("unmatched").isNull(), F.col("record_number")))
    keys = [c for c in ("import_session_id", "record_number", "stage", "severity", "code", "message") if c in union.columns]
    same = Window.partitionBy(*keys).orderBy("part", "ordinal")
    first = union.withColumn("place", F.row_number().over(same)).where("place = 1")
    stored = stored_stage(F.col("stage"))
    details = F.to_json(F.struct(F.when(stored != F.lower("stage"), F.col("stage")).alias("originalStage"), F.col("unmatched").alias("unmatchedRecordNumber")))
    return first.withColumn("details_json", details).withColumn("stage", stored).drop("place", "part", "known", "unmatched")


def missing_parts(spark_tables: dict[str, DataFrame], required: dict[str, list[str]]) -> list[str]:
    """Tables and columns (``table.column``) that ``required`` names and that are not there; of the schemas alone."""
    out = []
    for table, columns in required.items():
        if table not in spark_tables:
            out.append(table)
        else:
            out += [f"{table}.{c}" for c in columns if c not in spark_tables[table].columns]
    return out


def is_digest(column: str) -> Column:
    """A rule for ``check_contract``: 64 hexadecimal digits in lower case."""
    return F.col(column).rlike("^[0-9a-f]{64}$")


def adds_up(total: str, *parts: str) -> Column:
    """A rule for ``check_contract``: the parts' sum is the total."""
    return F.col(total) == reduce(lambda a, b: a + b, (F.col(p) for p in parts))


def check_contract(df: DataFrame, rules: dict[str, Column], unique: list[str] | None = None) -> DataFrame:
    """(rule, violations): how many rows break each rule; a condition that is null counts as broken.

    All row rules are counted in one pass; ``unique`` adds the number of keys that repeat.
    """
    counts = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules)))
    out = counts.select(pairs.alias("x")).select("x.*")
    if unique:
        repeated = df.groupBy(*unique).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("violations"))
        out = out.unionByName(repeated.select(F.lit("unique " + ",".join(unique)).alias("rule"), "violations"))
    return out
