"""Dropping repeated deliveries of any age: a ledger of ids in hash buckets, with a Bloom filter per bucket.

A stream's own deduplication forgets what the watermark has passed. The ledger keeps every id,
in ``ids/batch_id=.../bucket=...``, and per batch the filters of all buckets as they are after
it (``filters/batch_id=...``). A batch reads the newest filters and the ids of only those buckets
for which one of its ids may be known. Filters save reading and decide nothing:
fuller ones than planned for just let more buckets be read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.scratch import stored
from ledgerloom.streaming.capture import BATCH

BITS, HASHES = 32, 16  # per planned id: below one false alarm in 100,000
BUCKETS, IDS_PER_BUCKET = 64, 100_000
IDS = f"id string, {BATCH} long, bucket int"
FILTERS = "bucket int, of int, bits binary"


def _with_bucket(rows: DataFrame, column: str, buckets: int) -> DataFrame:
    return rows.select(F.col(column).alias("id"), F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int").alias("bucket"))


def _bits(ids: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte and the bit within it of every id's positions in a filter of ``size`` bytes."""
    first, step = (ids[c].to_numpy(np.int64).astype(np.uint64)[:, None] for c in ("h1", "h2"))
    at = (first + np.arange(HASHES, dtype=np.uint64) * (step | np.uint64(1))) % np.uint64(size * 8)
    return (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8))


def _cogrouped(ids: DataFrame, filters: DataFrame):
    hashed = ids.withColumns({"h1": F.xxhash64(F.lit(1), "id"), "h2": F.xxhash64(F.lit(2), "id")})
    return hashed.groupBy("bucket").cogroup(filters.groupBy("bucket"))


def suspects(ids: DataFrame, filters: DataFrame) -> DataFrame:
    """The ids (id, bucket) that their bucket's filter may know; a task holds a bucket's filter and its ids of the batch."""

    def probe(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if known.empty:
            return own.iloc[:0][["id", "bucket"]]
        bits = np.frombuffer(known["bits"].iloc[0], np.uint8)
        byte, bit = _bits(own, len(bits))
        return own[((bits[byte] & bit) != 0).all(axis=1)][["id", "bucket"]]

    return _cogrouped(ids, filters).applyInPandas(probe, "id string, bucket int")


def _merged_filters(ids: DataFrame, filters: DataFrame, buckets: int, size: int) -> DataFrame:
    """The filters of all buckets with the ids added; those without new ids are passed on."""

    def merge(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(size, np.uint8) if known.empty else np.frombuffer(known["bits"].iloc[0], np.uint8).copy()
        if len(own):
            np.bitwise_or.at(bits, *_bits(own, len(bits)))
        bucket = (known if own.empty else own)["bucket"].iloc[0]
        return pd.DataFrame({"bucket": [bucket], "of": [buckets], "bits": [bits.tobytes()]})

    return _cogrouped(ids, filters).applyInPandas(merge, FILTERS)


def _filters_before(spark: SparkSession, ledger: str, batch_id: int, buckets: int) -> DataFrame:
    every = stored(spark, f"{ledger}/filters", f"{FILTERS}, {BATCH} long")
    newest = None if every is None else every.where(F.col(BATCH) < batch_id).agg(F.max(BATCH)).first()[0]
    if newest is None:
        return spark.createDataFrame([], FILTERS)
    found = spark.read.schema(FILTERS).parquet(f"{ledger}/filters/{BATCH}={newest}")
    if found.where(F.col("of") != buckets).limit(1).count():
        raise ValueError("the ledger was begun with another number of buckets")
    return found


def known_ids(ids: DataFrame, filters: DataFrame, ledger: str, batch_id: int) -> DataFrame | None:
    """Those of the ids (id, bucket) that earlier batches delivered; None if no filter knows any.

    The list of suspected buckets comes to the driver: at most as many numbers as there are buckets.
    """
    suspected = suspects(ids, filters)
    read = [r.bucket for r in suspected.select("bucket").distinct().collect()]
    past = stored(ids.sparkSession, f"{ledger}/ids", IDS) if read else None
    return None if past is None else past.where(F.col(BATCH) < batch_id).where(F.col("bucket").isin(*read)).join(suspected, ["id", "bucket"], "left_semi").select("id")


def append_first_deliveries(
    batch: DataFrame, batch_id: int, path: str, ledger: str, column: str = "live_evidence_id", order: str = "occurred_ts", buckets: int = BUCKETS, ids_per_bucket: int = IDS_PER_BUCKET
) -> None:
    """Stores the batch's rows whose id no earlier batch delivered, however long ago.

    Of rows of one id within the batch the one with the least ``order`` stays; rows without an
    id can't be compared and all stay. The rows go to the batch's own folder under ``path``, its ids
    and filters to the ledger; a repeated batch sees only batches before it and
    replaces its own folders. ``buckets`` is fixed for a ledger (another number is refused); choose it so
    that a bucket gets about ``ids_per_bucket`` ids over the ledger's life. An empty batch passes the filters on.
    """
    spark = batch.sparkSession
    own = F.struct(*batch.columns)
    firsts = batch.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_id")).agg(F.min_by(own, F.struct(F.col(order).isNull(), order)).alias("row")).select("row.*")
    firsts = firsts.unionByName(batch.where(F.col(column).isNull())).persist()
    try:
        filters = _filters_before(spark, ledger, batch_id, buckets)
        ids = _with_bucket(firsts.where(F.col(column).isNotNull()), column, buckets)
        known = known_ids(ids, filters, ledger, batch_id)
        fresh = firsts if known is None else firsts.join(known.select(F.col("id").alias(column)), column, "left_anti").select(*batch.columns)
        fresh.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
        added = _with_bucket(spark.read.schema(batch.schema).parquet(f"{path}/{BATCH}={batch_id}").where(F.col(column).isNotNull()), column, buckets)
        added.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{ledger}/ids/{BATCH}={batch_id}")
        _merged_filters(added, filters, buckets, max(1, ids_per_bucket * BITS // 8)).write.mode("overwrite").parquet(f"{ledger}/filters/{BATCH}={batch_id}")
    finally:
        firsts.unpersist()


def first_delivery_sink(stream: DataFrame, path: str, ledger: str, checkpoint: str, **options):
    """Starts the query that stores a stream's first deliveries batch by batch; ``options`` as of ``append_first_deliveries``."""
    run = lambda batch, n: append_first_deliveries(batch, n, path, ledger, **options)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
