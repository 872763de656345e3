"""An audit of how quality filters interact, kept up to date file by file with Structured Streaming.

Each document gets a mask of the filters that it fails. All but the last filter look at the
text alone; the last, ``E``, fails a text that a document with a smaller id has too, wherever
in the table. Files are taken as micro-batches (available now). Within a partition of a
batch, rows with the same text and part are counted together first, so a text that fills a
third of the table is a few rows. The state, keyed by the text's digest, holds the smallest
id seen with that text and what rows bear it; when a smaller one arrives, the earlier ones'
masks are retracted from the counters of their parts and counted anew as copies. Texts are
held in buckets of some thousands, as a call of Python for every text would cost more than
all else; their number is set from the table's rows when the state is begun. Only
changes of the counters leave the stream: (part, mask, rows, good, toxic), a small table per
batch in a folder of its own, which a repeated batch replaces. The sums over all batches
hold at most 32 masks a part, and everything about all orders of the filters follows from them.

The state of a large table is kept in RocksDB, so it may be larger than memory; it is checkpointed
in the shared folder and survives lost executors. A stream that goes on from its checkpoint
takes only new files (``audit`` with ``folder``).

Edge cases: a null text is empty, a null part is the empty string. A row with a null id neither is a
copy nor makes one; rows with equal ids and texts don't make each other copies. Labels of
an id count if any of its rows has them. An empty table has no rows. Other columns are not read.
A very long text is one row's work.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import combinations, permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.llm import inputs
from ledgerloom.plans.scratch import fresh_folder, stored

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Limits of the filters; fixed values.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT, SIGNS = 50, 65, 5, "#$%&*|"
BATCHES = 4
LEAST_BUCKETS, TEXTS_PER_BUCKET = 256, 8192
PIECE_BYTES = 4_000_000
#: From so many rows on the state is kept in RocksDB, else in memory; its files would take megabytes a partition.
ROCKSDB_ROWS = 20_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
COUNTS = ("rows", "good", "toxic")


def text_masks(texts: pa.Array) -> np.ndarray:
    """Which of the filters that look at the text alone each text fails, a bit each; no text is null."""
    lists = pc.ascii_split_whitespace(texts)
    codes = lists.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
    code = codes.indices.to_numpy()
    empty = pc.index(codes.dictionary, "").as_py()  # beside white space at a text's ends
    doc, code = doc[code != empty], code[code != empty]
    words = np.bincount(doc, minlength=len(texts))
    distinct = np.bincount(np.unique(doc * len(codes.dictionary) + code) // max(1, len(codes.dictionary)), minlength=len(texts))
    capitals, chars = (x.to_numpy(zero_copy_only=False) for x in (pc.count_substring_regex(texts, "[A-Z]"), pc.utf8_length(texts)))
    signs = pc.match_substring_regex(texts, f"[{SIGNS}]").to_numpy(zero_copy_only=False)
    fails = (words < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * words, 100 * capitals.astype(np.int64) > MAX_CAPITALS_PERCENT * chars.astype(np.int64), signs)
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """A column piece by piece, each of at most ``PIECE_BYTES`` or one text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE_BYTES, "right")))
        yield texts.slice(a, b - a)
        a = b


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        found = [text_masks(x) for x in _slices(texts)]
        mask = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("text_key", "part", "doc_id")), mask], names=["text_key", "part", "doc_id", "mask"])


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text_key, part, mask, doc_id, rows, good, toxic) per document; the text goes no further."""
    text = inputs.whole_text()
    own = docs.select(F.unhex(F.sha2(text, 256)).alias("text_key"), F.coalesce("source", F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    own = own.mapInArrow(_masks, "text_key binary, part string, doc_id long, mask int")
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("key")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")
    )
    # null ids would all meet in one task
    keyed = own.withColumn("key", F.coalesce("doc_id", F.xxhash64("text_key")))
    count = lambda c: F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col(c)), F.lit(0)).alias(c)
    return keyed.join(known, "key", "left").select("text_key", "part", "mask", "doc_id", F.lit(1).cast("long").alias("rows"), count("good"), count("toxic"))


COMBINED = "text_key binary, part string, mask int, doc_id long, rows long, good long, toxic long, least_rows long, least_good long, least_toxic long"


def combine(rows: DataFrame) -> DataFrame:
    """Rows of a partition with the same text and part as one: the sums, the least id, and the sums of the rows that bear it; rows without an id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.append_column("no_id", pc.is_null(table["doc_id"]))
            by_id = table.group_by(["text_key", "part", "mask", "doc_id", "no_id"]).aggregate([(c, "sum") for c in COUNTS])
            least = by_id.group_by(["text_key", "part", "mask", "no_id"]).aggregate([("doc_id", "min"), *((f"{c}_sum", "sum") for c in COUNTS)])
            joined = least.append_column("doc_id", least["doc_id_min"]).join(by_id.rename_columns({f"{c}_sum": f"least_{c}" for c in COUNTS}), ["text_key", "part", "mask", "no_id", "doc_id"], join_type="left outer")
            out = [joined[c] for c in ("text_key", "part", "mask", "doc_id")] + [joined[f"{c}_sum_sum"] for c in COUNTS] + [pc.fill_null(joined[f"least_{c}"], 0) for c in COUNTS]
            yield from pa.Table.from_arrays(out, [x.split()[0] for x in COMBINED.split(", ")]).to_batches()

    return rows.mapInArrow(run, COMBINED)


CHANGES = "part string, mask int, rows long, good long, toxic long"
HELD = "texts string"


class Held:
    """Of some texts, which id is the least so far and what rows bear it per part; and how the counters change as rows arrive."""

    def __init__(self, texts: dict[str, tuple[int, dict[str, list[int]]]] | None = None) -> None:
        self.texts = texts or {}
        self.changes: dict[tuple[str, int], list[int]] = {}

    def _count(self, part: str, mask: int, counts: Sequence[int], sign: int = 1) -> None:
        sums = self.changes.setdefault((part, mask), [0, 0, 0])
        for i, n in enumerate(counts):
            sums[i] += sign * n

    def add(self, key: str, part: str, mask: int, doc_id: int | None, counts: Sequence[int], least_counts: Sequence[int]) -> None:
        """Rows of one text and part: all their counts, and those of the rows with the smallest id among them."""
        if doc_id is None:
            self._count(part, mask, counts)
            return
        self._count(part, mask | COPY, counts)
        least, parts = self.texts.get(key, (None, {}))
        if least is None or doc_id < least:
            for p, held in parts.items():  # retract what was the first so far, and count it anew as a copy
                self._count(p, mask, held, -1)
                self._count(p, mask | COPY, held)
            self.texts[key] = least, parts = doc_id, {}
        if doc_id == least:
            parts[part] = [a + b for a, b in zip(parts.get(part, (0, 0, 0)), least_counts, strict=True)]
            self._count(part, mask | COPY, least_counts, -1)
            self._count(part, mask, least_counts)


def _keep(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = Held(json.loads(state.get[0]) if state.exists else None)
    for frame in frames:
        columns = [frame[x.split()[0]].tolist() for x in COMBINED.split(", ")]
        for key, part, mask, doc_id, *counts in zip(*columns, strict=True):
            held.add(key, part, mask, int(doc_id) if isinstance(doc_id, str) else None, counts[:3], counts[3:])
    state.update((json.dumps(held.texts),))
    out = [(p, m, *c) for (p, m), c in held.changes.items() if any(c)]
    yield pd.DataFrame(out, columns=[x.split()[0] for x in CHANGES.split(", ")])


def changes(stream: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """The changes of the counters (part, mask, rows, good, toxic) that a stream of documents makes."""
    # ids are passed as text: those beyond 2 ** 53 would be rounded where a frame with nulls has floats
    rows = combine(masked(stream, labels)).withColumns({"doc_id": F.col("doc_id").cast("string"), "text_key": F.hex("text_key")})
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("text_key"), F.lit(buckets)))
    return rows.groupBy("bucket").applyInPandasWithState(_keep, CHANGES, HELD, "append", GroupStateTimeout.NoTimeout)


def audit(spark: SparkSession, path: str, labels: DataFrame, folder: str | None = None, batches: int = BATCHES) -> DataFrame:
    """(part, mask, rows, good, toxic) over all documents under ``path``, taken in about so many micro-batches; with a ``folder`` used before, only new files are read."""
    folder = folder or fresh_folder(spark, "audit")
    docs = spark.read.parquet(path)
    schema = docs.select("doc_id", "text", "source").schema
    set_up = stored(spark, f"{folder}/buckets")
    if set_up is None:  # the state's buckets stay as they are once it is begun
        rows = docs.count()  # from the files' footers
        set_up = spark.range(1).select(F.lit(max(LEAST_BUCKETS, rows // TEXTS_PER_BUCKET)).alias("buckets"), F.lit(rows >= ROCKSDB_ROWS).alias("rocksdb"))
        set_up.write.mode("overwrite").parquet(f"{folder}/buckets")
    buckets, rocksdb = set_up.select("buckets", "rocksdb").first()
    files = -(-max(1, len(docs.inputFiles())) // batches)
    one = f"{path[:-1]}[{path[-1]}]"  # as a pattern, the path may be a folder or a single file
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(one)

    def store(batch: DataFrame, n: int) -> None:
        sums = batch.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS))
        sums.write.mode("overwrite").parquet(f"{folder}/changes/batch={n}")

    before = spark.conf.get(PROVIDER)
    if rocksdb:
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        running = changes(stream, labels, buckets).writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
    running.awaitTermination()
    counted = stored(spark, f"{folder}/changes", f"{CHANGES}, batch int")
    if counted is None:  # no file held a row
        return spark.createDataFrame([], CHANGES)
    return counted.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS))


def interactions(counters: DataFrame) -> DataFrame:
    """Per part, order of all filters and step what that step keeps and removes, from (part, mask, rows, good, toxic).

    A step depends on its filter and on which ones came before it, so each part's masks are
    summed for 5 x 16 such cases, and those are joined to the steps of the 120 orders.
    """
    spark = counters.sparkSession
    every = range(len(FILTERS))
    cases = [(f, sum(1 << i for i in before)) for f in every for k in every for before in combinations([i for i in every if i != f], k)]
    mask = F.col("mask")
    per_case = F.explode(F.array(*(F.struct(F.lit(f).alias("filter"), F.lit(b).alias("before")) for f, b in cases))).alias("case")
    rows = counters.select("part", "mask", *COUNTS, per_case).select("part", "mask", *COUNTS, "case.*")
    bit = F.shiftright(mask, 0).bitwiseAND(F.expr("shiftleft(1, filter)")) != 0
    gone = mask.bitwiseAND(F.col("before")) != 0
    total = lambda when, c="rows": F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    # of all orders, the share in which a filter is the first of those that a mask fails
    share = F.when(bit, F.col("rows") * F.expr("120 / bit_count(mask)").cast("long"))
    summed = rows.groupBy("part", "filter", "before").agg(
        total(~bit & ~gone).alias("kept"), total(bit & ~gone).alias("removed"), total(bit & gone).alias("redundant"),
        total(mask == F.expr("shiftleft(1, filter)")).alias("unique_fails"), total(bit & ~gone, "good").alias("good_lost"), total(bit & ~gone, "toxic").alias("toxic_lost"),
        F.coalesce(F.sum(share), F.lit(0)).cast("long").alias("shapley"),
    )
    steps = [
        ("".join(FILTERS[i] for i in order), s + 1, order[s], sum(1 << i for i in order[:s])) for order in permutations(every) for s in every
    ]
    plan = spark.createDataFrame(steps, "filter_order string, step int, filter int, before int")  # 600 rows
    return summed.join(F.broadcast(plan), ["filter", "before"]).drop("filter", "before")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every order of five filters keeps and removes, per source."""
    counters = audit(spark, f"{sf_dir}/documents.parquet", inputs.table(spark, sf_dir, "labels"))
    return interactions(counters).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


OP12_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents)
, w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t)
, m AS (SELECT doc_id, part, len(words) < {MIN_WORDS} AS a, 100 * len(list_distinct(words)) < {MIN_DISTINCT_PERCENT} * len(words) AS b,
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {MAX_CAPITALS_PERCENT} * length(text) AS c, regexp_matches(text, '[{SIGNS}]') AS d, coalesce(doc_id > least, false) AS e FROM w)
, l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id)
, f AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL)
, x AS (SELECT unnest(string_split('ABCDE', '')) AS c)
, orders AS (SELECT p.c || q.c || r.c || s.c || t.c AS filter_order FROM x AS p, x AS q, x AS r, x AS s, x AS t WHERE len(list_distinct([p.c, q.c, r.c, s.c, t.c])) = 5)
, steps AS (SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, k, 1) AS own, substr(filter_order, 1, k - 1) AS earlier FROM orders, range(1, 6) AS r(k))
, judged AS (SELECT part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) AS hit, length(translate(fails, earlier, '')) < length(fails) AS gone FROM f, steps)
, out AS (SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (hit AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = own), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS BIGINT) AS toxic_lost FROM judged GROUP BY ALL)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM out
"""
