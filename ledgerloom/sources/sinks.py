"""Sinks: chained JSON lines, manifests, and the audit mart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.integrity import build_chain, output_manifest
from ledgerloom.sources.publication import publish


def canonical_json(df: DataFrame) -> Column:
    """The row as JSON with its fields in alphabetical order; nulls are written."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def write_chained_jsonl(df: DataFrame, chain: str, order: str, path: str) -> DataFrame:
    """Writes each chain's rows in order as JSON lines with their hashes, a folder per chain; returns the manifest of what was written.

    Refuses row numbers that are not positive or that repeat within a chain. The task that
    chains the rows writes them, since a chain's file is in its order.
    """
    broken = df.groupBy(chain, order).count().where(f"count > 1 or {order} <= 0").limit(1).count()
    if broken:
        raise ValueError("row numbers must be positive and unique within a chain")
    rows = df.select(F.col(chain).cast("string").alias("chain"), F.col(order).cast("long").alias("n"), canonical_json(df).alias("payload"))
    chained = build_chain(rows, "chain", "n", F.col("payload"), ["payload"])
    lines = chained.select("chain", F.to_json(F.struct("content_hash", "entry_hash", "n", "payload", "previous_hash", "version")).alias("value"))
    lines.write.partitionBy("chain").text(path)
    fields = F.from_json("value", "n long, entry_hash string")
    written = df.sparkSession.read.schema("value string, chain string").text(path).select("chain", fields.alias("line")).select("chain", "line.*")
    return output_manifest(written, rows.groupBy("chain").agg(F.count("*").alias("entries")))


def write_audit_mart(tables: dict[str, DataFrame], path: str, import_id: str) -> None:
    """Publishes the tables of one import under ``path``, all or nothing; they are read by ``published``.

    Writing an import again replaces what it wrote before, so a failed run may be repeated.
    """
    spark = next(iter(tables.values())).sparkSession
    publish(spark, path, {name: df.withColumn("import", F.lit(import_id)) for name, df in tables.items()}, import_id)


def raw_event_summaries(raw: DataFrame, limit: int) -> DataFrame:
    """The first raw events by their sequence, 1 to 1000 of them, without their XML."""
    if not 1 <= limit <= 1000:
        raise ValueError("the limit must lie between 1 and 1000")
    return raw.drop("raw_xml").orderBy("ingest_sequence").limit(limit)
