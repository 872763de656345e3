"""Order MinHash: fingerprints of texts that are sensitive to edit distance.

The k-mers (runs of ``K`` code points) of a text are numbered by occurrence, so that the
third "the " differs from the first. Each of ``SLOTS`` hash functions picks the ``PICKS``
least of these numbered k-mers, puts them back into text order and hashes that tuple to 32
bits. The likeness of two fingerprints is the share of slots that agree; it falls both
where k-mers are missing and where they are in another order.

Edge cases: a null text is empty; a text shorter than K has one k-mer, itself; an empty
text has none and its slots hash the empty tuple, so two empty texts are alike. A text with
fewer than ``PICKS`` k-mers gives tuples of all of them. Equal texts have equal
fingerprints. In ``edited_fingerprints`` rows are ordered by id descending, equal ids by the
hash of their text descending, null ids last; a single row is its own next one. An empty
table gives no rows, and of the input only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import inputs, wordgrams

K = 8
PICKS = 2
SLOTS = 64
SEED = 2
STRIDE = 2048
RANGES_PER_PARTITION = 4
EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _numbered(text: str, k: int) -> np.ndarray:
    """A 64-bit hash for each k-mer with its occurrence number, in text order."""
    points, _ = wordgrams.code_points([text])
    n = len(points)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    prefix = wordgrams.prefix_hash(points)
    at = np.arange(n - k + 1)
    total, down = prefix
    mers = wordgrams.mix64((total[k:] - total[:-k]) * down[: n - k + 1])
    # equal k-mers side by side, in text order: the high bits of the hash, then the position
    bits = np.uint64(max(1, int(len(mers) - 1).bit_length()))
    packed = np.sort((mers >> bits << bits) | at.astype(np.uint64))
    high, position = packed >> bits, (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    fresh = np.concatenate(([True], high[1:] != high[:-1]))
    run = np.arange(len(mers)) - np.maximum.accumulate(np.where(fresh, np.arange(len(mers)), 0))
    number = np.empty(len(mers), np.uint64)
    number[position] = run.astype(np.uint64)
    repeated = number > 0
    mers[repeated] = wordgrams.mix64(mers[repeated] + number[repeated] * np.uint64(0x9E3779B97F4A7C15))
    return mers


def fingerprint(text: str, k: int = K, slots: int = SLOTS) -> np.ndarray:
    """The fingerprint of a text, as ``slots`` 32-bit numbers."""
    mers = _numbered(text, k)
    xor, factor = (x[:, None] for x in wordgrams.hash_functions(slots, SEED))
    low = (mers >> np.uint64(32)).astype(np.uint32)
    rows = np.arange(slots)
    values, places = np.zeros((slots, 0), np.uint32), np.zeros((slots, 0), np.int64)
    space = np.empty((slots, min(STRIDE, len(low))), np.uint32)
    for begin in range(0, len(low), STRIDE):  # the least of each stretch, then of those
        part = low[begin : begin + STRIDE]
        block = np.bitwise_xor(part, xor, out=space[:, : len(part)])
        block *= factor
        for _ in range(min(PICKS, block.shape[1])):
            at = block.argmin(axis=1)
            values = np.column_stack((values, block[rows, at]))
            places = np.column_stack((places, at + begin))
            block[rows, at] = 0xFFFFFFFF
    picks = min(PICKS, len(mers))
    best = np.argsort(values, axis=1, kind="stable")[:, :picks]
    place = np.sort(np.take_along_axis(places, best, axis=1), axis=1)
    out = np.full(slots, 1, np.uint64)
    for j in range(picks):
        out = wordgrams.mix64(out * np.uint64(0x100000001B3) + mers[place[:, j]])
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def _hex(x: np.ndarray) -> str:
    return x.astype(">u4").tobytes().hex()


def fingerprint_column(text: str = "text", k: int = K, slots: int = SLOTS):
    """The fingerprint of a text column, as hexadecimal digits."""

    def of(column: pa.Array) -> pa.Array:
        return pa.array([_hex(fingerprint(t or "", k, slots)) for t in column.to_pylist()], pa.string())

    return F.arrow_udf(of, "string")(F.col(text))


def _rows(items: Iterable[tuple[int, int | None, str, bool]]) -> Iterator[tuple]:
    """Output rows of one range after the other; the last item of a range is only the next one of its last row."""
    before: tuple | None = None
    for part, doc_id, text, closing in items:
        own = fingerprint(text)
        if before and before[0] == part:
            _, id_, old, print_ = before
            cut = len(old) // 3
            edited = old[: len(old) - cut] + text[:cut]
            changed = fingerprint(edited)
            digest = hashlib.sha256(edited.encode()).hexdigest()
            yield id_, len(old), digest, _hex(print_), _hex(changed), likeness(print_, changed), likeness(print_, own)
        before = None if closing else (part, doc_id, text, own)


def _ranges(ids: DataFrame, n: int) -> tuple[list[int], list[int]]:
    """Bounds that cut the ids into about ``n`` ranges, and the ids that fill a range alone; so many numbers reach the driver at most."""
    bounds = ids.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
    bounds = bounds or []
    return sorted(set(bounds)), sorted({a for a, b in zip(bounds, bounds[1:], strict=False) if a == b})


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs`` (doc_id, text), of each text's edit with the next one's beginning, and likenesses.

    The rows are dealt out by ranges of ids (a much repeated id, or none, by ranges of the
    text's hash as well), and sorted within each; the first row of a
    range also goes to the end of the range before it (that of the first range to the
    last), as the next one of its last row. So texts are shuffled once, and no task needs
    more than the row before it.
    """
    docs = docs.select(F.col("doc_id").cast("long"), inputs.whole_text().alias("text"))
    spark = docs.sparkSession
    bounds, repeated = _ranges(docs, int(spark.conf.get("spark.sql.shuffle.partitions")) * RANGES_PER_PARTITION)
    number = F.lit(len(bounds))
    if bounds:
        array = F.array(*map(F.lit, reversed(bounds)))
        place = F.size(F.filter(array, lambda b: F.col("doc_id") < b))
        number = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(place)  # range 0 has the largest ids
    # ids equal to a bound come last in their range; the leading bits of the hash split them
    split = F.when(F.col("doc_id").isNull() | F.col("doc_id").isin(repeated), F.lit(8) - F.shiftright(F.xxhash64("text"), 60).cast("int")).otherwise(0)
    docs = docs.withColumn("part", number * 32 + split)
    tops = docs.groupBy("part").agg(F.max(F.struct("doc_id", F.xxhash64("text").alias("h"))).alias("top")).orderBy("part").collect()
    if not tops:
        return spark.createDataFrame([], EDITED)
    present = [r["part"] for r in tops]
    before = dict(zip(present, [present[-1], *present[:-1]], strict=True))
    heads = spark.createDataFrame(
        [(r["part"], r["top"]["doc_id"], r["top"]["h"], before[r["part"]]) for r in tops],
        "head_part int, head_id long, head_hash long, before int",
    )
    order = ["closing", F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()]
    marked = docs.join(
        F.broadcast(heads),  # one row per range
        (F.col("part") == F.col("head_part"))
        & F.col("doc_id").eqNullSafe(F.col("head_id"))
        & (F.xxhash64("text") == F.col("head_hash")),
        "left",
    )
    once = F.when(F.col("before").isNull(), F.array(F.struct("part", F.lit(False).alias("closing")))).otherwise(
        F.array(F.struct("part", F.lit(False).alias("closing")), F.struct(F.col("before").alias("part"), F.lit(True).alias("closing")))
    )
    dealt = (
        marked.select("doc_id", "text", F.explode(once).alias("to"))
        .select(F.col("to.part").alias("part"), "doc_id", "text", F.col("to.closing").alias("closing"))
        .repartition(F.col("part"))
        .sortWithinPartitions("part", *order)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        rows, size = [], 0
        for row in _rows(items):
            rows.append(row)
            size += 1
            if size == 1000:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    return dealt.mapInArrow(run, EDITED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [x.split()[0] for x in EDITED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return edited_fingerprints(inputs.table(spark, sf_dir, "documents"))
