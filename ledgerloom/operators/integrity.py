"""Hash chains over records: building, verifying, manifests and canonical payloads."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerloom.functions.columns import GENESIS
from ledgerloom.operators.ordering import before

VERSION = "1"
LINE = "content_hash string, entry_hash string, n long, payload string, previous_hash string, version string, _corrupt_record string"


def entry_hash(previous: Column, content: Column, version: Column | str = VERSION) -> Column:
    """SHA-256 of version, previous entry and content hash, a line each."""
    v = F.lit(version) if isinstance(version, str) else version
    return F.sha2(F.concat_ws("\n", v, previous, content), 256)


def fold_hashes(df: DataFrame, chain: str, order: str, parts: Sequence[str], step: Callable[..., str], tails: DataFrame | None = None) -> DataFrame:
    """``df`` with previous_hash and entry_hash, where an entry is ``step(previous, *parts)``.

    Only this fold is sequential by definition: rows are dealt out by chain and sorted, and a
    task streams through them holding one hash, so a chain may be longer than memory. With
    ``tails`` (the chain's column, entry_hash) a chain goes on from a stored entry.
    """
    columns = df.columns
    rows = df.withColumn("_tail", F.lit(None).cast("string"))
    if tails is not None:
        rows = rows.unionByName(tails.select(chain, F.col("entry_hash").alias("_tail")), allowMissingColumns=True)
    # by a hash of the chain, as no join or aggregation deals rows by that: a repartition by the chain itself is left out where
    # both sides of the union seem to lie by it already, and their partitions may still be merged, or split, each for itself
    ordered = rows.repartition(F.xxhash64(chain)).sortWithinPartitions(chain, F.col("_tail").isNull(), order)
    schema = StructType([*df.schema.fields, StructField("previous_hash", StringType()), StructField("entry_hash", StringType())])
    at, used = columns.index(chain), [columns.index(p) for p in parts]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, now, previous = True, None, GENESIS
        for batch in batches:
            tails, chains = batch.column(len(columns)).to_pylist(), batch.column(at).to_pylist()
            values = [batch.column(i).to_pylist() for i in used]
            kept, begun, ended = [], [], []
            for i, (c, tail, *own) in enumerate(zip(chains, tails, *values, strict=True)):
                if first or c != now:
                    first, now, previous = False, c, GENESIS
                if tail is not None:
                    previous = tail
                    continue
                kept.append(i)
                begun.append(previous)
                previous = step(previous, *own)
                ended.append(previous)
            whole = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*whole.columns[: len(columns)], pa.array(begun, pa.string()), pa.array(ended, pa.string())], names=schema.names)

    return ordered.mapInArrow(fold, schema)


def _entry(previous: str, content: str) -> str:
    return hashlib.sha256(f"{VERSION}\n{previous}\n{content}".encode()).hexdigest()


def build_chain(df: DataFrame, chain: str, order: str, payload: Column, carry: Sequence[str] = (), tails: DataFrame | None = None) -> DataFrame:
    """(chain, n, carry..., content_hash, previous_hash, entry_hash, version): entries chained within ``chain`` by ``order``.

    Content hashes are worked out row by row in parallel; ``carry`` names columns that go
    along. With ``tails`` (chain, entry_hash) chains go on from what is stored.
    """
    rows = df.withColumn("content_hash", F.sha2(payload, 256)).select(
        F.col(chain).cast("string").alias("chain"), F.col(order).cast("long").alias("n"), *carry, "content_hash"
    )
    return fold_hashes(rows, "chain", "n", ["content_hash"], _entry, tails).withColumn("version", F.lit(VERSION))


def read_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines (chain, n as they lie in their file, and the text) as the columns of a chain; ``broken`` marks what is no JSON object."""
    parsed = F.from_json(F.col(column), LINE, {"mode": "PERMISSIVE"})
    return lines.withColumn("_line", parsed).select(
        "chain", "n", *(F.col(f"_line.{c}").alias(c) for c in ("version", "previous_hash", "content_hash", "entry_hash", "payload")),
        (F.col(column).isNull() | F.col("_line._corrupt_record").isNotNull()).alias("broken"),
    )


def verify_chain(df: DataFrame, payload: Column | None = None, initial_previous: str = GENESIS) -> DataFrame:
    """(chain, entries, first_bad, reason) per chain; the first entry that fails and why, null for a sound chain.

    Reasons, the first that holds: invalid_json, missing_or_invalid_chain_field,
    unsupported_version, and then for each hash invalid_hash_encoding or that it differs:
    previous_hash_mismatch, content_hash_mismatch, entry_hash_mismatch. Each entry is compared
    with its neighbour and with its own recomputed hashes, all in parallel; the first failure
    is the one that a walk along the chain would meet.
    """
    linked = before(df, ["chain"], "n", "entry_hash", "_before")
    content = F.col("content_hash") if payload is None else F.sha2(payload, 256)
    mine = entry_hash(F.col("previous_hash"), F.col("content_hash"), F.col("version"))
    wanted = {"previous_hash": F.coalesce("_before", F.lit(initial_previous)), "content_hash": content, "entry_hash": mine}
    absent = F.col("version").isNull()
    for c in wanted:
        absent = absent | F.col(c).isNull()
    reason = F.when(F.col("broken"), "invalid_json") if "broken" in df.columns else F.when(F.lit(False), "")
    reason = reason.when(absent, "missing_or_invalid_chain_field").when(F.col("version") != VERSION, "unsupported_version")
    for c, right in wanted.items():
        reason = reason.when(~F.col(c).rlike("^([0-9a-fA-F]{2})*$"), "invalid_hash_encoding").when(F.lower(c) != right, f"{c}_mismatch")
    bad = F.when(F.col("reason").isNotNull(), F.col("n"))
    return linked.withColumn("reason", reason).groupBy("chain").agg(F.count("*").alias("entries"), F.min(bad).alias("first_bad"), F.min_by("reason", bad).alias("reason"))


def output_manifest(chained: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Per chain the number of entries and the first and last entry's hash.

    With ``expected`` (chain, entries) also its status: complete, incomplete if entries are
    missing, empty if there are none.
    """
    manifest = chained.groupBy("chain").agg(
        F.count("*").alias("entries"), F.min_by("entry_hash", "n").alias("first_hash"), F.max_by("entry_hash", "n").alias("last_hash")
    )
    if expected is None:
        return manifest
    both = expected.select("chain", F.col("entries").alias("expected")).join(manifest, "chain", "left").withColumn("entries", F.coalesce("entries", F.lit(0)).cast("long"))
    return both.withColumn("status", F.when(F.col("entries") == F.col("expected"), "complete").when(F.col("entries") == 0, "empty").otherwise("incomplete"))


def encoded(*columns: Column) -> Column:
    """Fields as bytes: for each a four-byte length and its UTF-8 text; null has the length -1."""
    length = lambda text: F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0"))
    field = lambda text: F.coalesce(F.concat(length(text), text.cast("binary")), F.unhex(F.lit("FFFFFFFF")))
    return F.concat(*(field(c.cast("string")) for c in columns))


def payload_hash(columns: Sequence[Column], missing: Column | None = None) -> Column:
    """SHA-256 over encoded fields, and behind them the names in ``missing`` in order, each as ``missing:`` and the name."""
    data = encoded(*columns)
    if missing is not None:
        names = F.aggregate(F.array_sort(missing), F.lit("").cast("binary"), lambda a, name: F.concat(a, encoded(F.concat(F.lit("missing:"), name))))
        data = F.concat(data, names)
    return F.sha2(data, 256)


def chain_raw_events(raw: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """Raw events chained per import: content is the raw id, XML digest and place, joined by U+001F.

    ``raw`` has import_session_id, record_number, raw_event_id and xml_sha256. Imports are
    chained on their own; ``output_manifest`` gives their heads, and ``tails`` (chain, n,
    entry_hash) those that are stored: numbers go on from them.
    """
    rows = raw.withColumn("chain", F.col("import_session_id").cast("string"))
    if tails is not None:
        last = tails.select("chain", F.col("n").alias("_stored"))
        rows = rows.join(last, "chain", "left").withColumn("record_number", F.col("record_number") + F.coalesce("_stored", F.lit(0))).drop("_stored")
        tails = tails.select("chain", "entry_hash")
    payload = F.concat_ws("\u001f", "raw_event_id", "xml_sha256", F.col("record_number").cast("string"))
    return build_chain(rows, "chain", "record_number", payload, ["raw_event_id"], tails)
