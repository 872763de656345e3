"""Benchmark decontamination: short test items found inside long documents.

Items are partitioned by their number of shingles into classes of doubling size. For a
class of size s a document is cut into blocks of s consecutive shingles; an item's
occurrence lies within two neighbouring blocks, so such a window is never much larger than
the item and their likeness is high (above 0.19 at a containment of 0.8), however long the
document is. A window and an item are candidates if they agree in any of ``FUNCTIONS``
minimum hashes (missed at that likeness with a chance near one in a million). Candidates
are verified over the whole document: the share of the item's distinct shingles that the
document has. The minima of a larger class come from those of the smaller one. Items of at
most ``EXACT`` distinct shingles, half the smallest class, would be less alike; their
shingles are looked up one by one, which misses nothing.

Items reach the tasks as a broadcast of at most ``BLOCK_ITEMS`` items with at most
``BLOCK_SHINGLES`` shingles; a larger benchmark is a stated query set that is searched in
blocks of that size, each against all rows. Nothing of the documents is shuffled.

Edge cases: null or empty texts (no words) contain nothing; items without words are never
found; items of fewer than five words are found through runs of as many words; repeated
items and documents give a row each, also those without an id; empty tables give no rows. Of the documents only the
id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import inputs, wordgrams

FUNCTIONS = 64
SEED = 8
CONTAINMENT = 0.8
BLOCK_ITEMS = 20_000
BLOCK_SHINGLES = 2_000_000
SMALLEST = 16
EXACT = SMALLEST // 2
FOUND = "doc_id long, item_id long, item_shingles int, shared int, containment double"


class Items:
    """A block of items as the tasks need it."""

    def __init__(self, ids: list[int | None], texts: list[str], k: int) -> None:
        self.k, self.ids = k, ids
        hashes, begins = wordgrams.words(texts)
        counts = np.diff(begins)
        shingle, at = wordgrams.shingles(hashes, begins, k)
        self.shingles = [np.unique(shingle[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        long = np.flatnonzero(counts >= k)
        #: By number of words, the hashes in order of the items too short for a shingle of k words, and whose each is.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, k):
            own = np.flatnonzero(counts == n)
            if len(own):
                whole = np.array([self.shingles[i][0] for i in own], np.uint64)
                order = np.argsort(whole, kind="stable")
                self.short[n] = whole[order], own[order]
        sizes = np.array([len(s) for s in self.shingles])
        few = long[sizes[long] <= EXACT]
        flat = np.concatenate([self.shingles[i] for i in few]) if len(few) else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        #: The shingles of items of at most ``EXACT`` in order, and whose each is.
        self.few = flat[order], np.repeat(few, sizes[few])[order]
        long = long[sizes[long] > EXACT]
        self.classes: list[tuple[int, np.ndarray]] = []  # size, items
        size, least = SMALLEST, 0
        while len(long) and least < sizes[long].max():
            members = long[(sizes[long] > least) & (sizes[long] <= size)]
            self.classes.append((size, members))
            least, size = size, size * 2
        self.functions = wordgrams.hash_functions(FUNCTIONS, SEED)
        self.low_bits: dict[int, np.ndarray] = {}
        #: Per class and function: the items' minima in order, whose item each is, and which low bits occur.
        self.index = []
        for _, members in self.classes:
            if not len(members):
                self.index.append(None)
                continue
            flat = np.concatenate([self.shingles[i] for i in members])
            starts = np.concatenate(([0], np.cumsum([len(self.shingles[i]) for i in members])[:-1]))
            minima = wordgrams.min_hashes(flat, starts, self.functions)
            order = np.argsort(minima, axis=1, kind="stable")
            self.index.append((np.take_along_axis(minima, order, 1), members[order]))

    def bits(self, c: int) -> np.ndarray:
        """Which low 16 bits the minima of a class have, by function; made where it is used."""
        if c not in self.low_bits:
            out = np.zeros((FUNCTIONS, 1 << 16), bool)
            for j in range(FUNCTIONS):
                out[j, self.index[c][0][j] & 0xFFFF] = True
            self.low_bits[c] = out
        return self.low_bits[c]

    def search(self, texts: list[str], least: float) -> Iterator[tuple[int, int, int, int]]:
        """(text number, item number, the item's shingles, how many of them the text has)."""
        word, word_begins = wordgrams.words(texts)
        shingle, begins = wordgrams.shingles(word, word_begins, self.k)
        pairs = set(self._candidates(shingle, begins)) if len(shingle) else set()
        yield from self._looked_up(shingle, begins, least)
        for n, (keys, owners) in self.short.items():
            run, at = wordgrams.shingles(word, word_begins, n)
            for d, i, _ in self._shared(run, at, keys, owners):
                if word_begins[d + 1] - word_begins[d] >= n:
                    yield d, i, 1, 1
        own: tuple[int, np.ndarray] = (-1, shingle[:0])
        for d, i in sorted(pairs):
            if own[0] != d:
                own = d, np.unique(shingle[begins[d] : begins[d + 1]])
            item = self.shingles[i]
            shared = len(np.intersect1d(item, own[1], assume_unique=True))
            if shared >= least * len(item) - 1e-9:
                yield d, i, len(item), shared

    def _looked_up(self, shingle: np.ndarray, begins: np.ndarray, least: float) -> Iterator[tuple[int, int, int, int]]:
        """As ``search``, for the items of at most ``EXACT`` shingles."""
        for d, i, m in self._shared(shingle, begins, *self.few):
            n = len(self.shingles[i])
            if m >= least * n - 1e-9:
                yield d, i, n, m

    def _shared(self, shingle: np.ndarray, begins: np.ndarray, keys: np.ndarray, owners: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text number, item number, how many of the item's keys the text has)."""
        if not len(keys):
            return
        left = np.searchsorted(keys, shingle, "left")
        hit = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == shingle)
        doc = np.searchsorted(begins, hit, "right") - 1
        doc, left = np.divmod(np.unique(doc * len(keys) + left[hit]), len(keys))  # a document's distinct shingles
        counts = np.searchsorted(keys, keys[left], "right") - left
        at = np.repeat(left - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        pair, shared = np.unique(np.repeat(doc, counts) * len(self.ids) + owners[at], return_counts=True)
        for d, i, m in zip(*np.divmod(pair, len(self.ids)), shared, strict=True):
            yield int(d), int(i), int(m)

    def _candidates(self, shingle: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int]]:
        counts = np.diff(begins)
        docs = np.flatnonzero(counts)
        counts, first = counts[docs], begins[:-1][docs]
        blocks = -(-counts // SMALLEST)
        owner = np.repeat(np.arange(len(docs)), blocks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        minima = wordgrams.min_hashes(shingle, first[owner] + number * SMALLEST, self.functions)
        size = SMALLEST
        for c, (wanted, _) in enumerate(self.classes):
            while size < wanted:
                even = np.flatnonzero(number % 2 == 0)
                minima = np.minimum.reduceat(minima, even, axis=1)
                owner, number, size = owner[even], number[even] // 2, size * 2
            if self.index[c] is None:
                continue
            bits, (keys, members) = self.bits(c), self.index[c]
            # a window's minimum is that of one of its two blocks, so all matches of windows are among those of blocks
            for j in range(FUNCTIONS):
                hit = np.flatnonzero(bits[j][minima[j] & 0xFFFF])
                left = np.searchsorted(keys[j], minima[j][hit], "left")
                right = np.searchsorted(keys[j], minima[j][hit], "right")
                for b, x, y in zip(hit[right > left], left[right > left], right[right > left], strict=True):
                    for i in members[j][x:y]:
                        yield int(docs[owner[b]]), int(i)


def _search(docs: DataFrame, items: Broadcast, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Items = items.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in wordgrams.slices(texts):
                rows = [(ids[a + d], block.ids[i], n, m, m / n) for d, i, n, m in block.search(texts[a:b], least)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), TYPES, strict=True)],
                        names=["doc_id", "item_id", "item_shingles", "shared", "containment"],
                    )

    return docs.mapInArrow(run, FOUND)


TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())


def _blocks(spark: SparkSession, benchmark: DataFrame, k: int) -> Iterator[Items]:
    """The benchmark's items, so many at a time as a broadcast may hold."""
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", inputs.whole_text().alias("text")).toLocalIterator():
        if ids and (len(ids) == BLOCK_ITEMS or size + len(row.text) // 2 > BLOCK_SHINGLES):
            yield Items(ids, texts, k)
            ids, texts, size = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text) // 2
    if ids:
        yield Items(ids, texts, k)


def contained_items(docs: DataFrame, benchmark: DataFrame, least: float = CONTAINMENT, k: int = wordgrams.SHINGLE_WORDS) -> DataFrame:
    """A row for every document (doc_id, text) and item (item_id, text) whose containment is at least ``least``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    found = [_search(docs, spark.sparkContext.broadcast(block), least) for block in _blocks(spark, benchmark, k)]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], FOUND)


def _clean(items: Broadcast, least: float) -> Column:
    def of(column: pa.Array) -> pa.Array:
        texts = [t or "" for t in column.to_pylist()]
        out = np.ones(len(texts), bool)
        for a, b in wordgrams.slices(texts):
            out[[a + d for d, *_ in items.value.search(texts[a:b], least)]] = False
        return pa.array(out)

    return F.arrow_udf(of, "boolean")(F.col("text"))


def clean_column(
    spark: SparkSession, benchmark: DataFrame, least: float = CONTAINMENT, k: int = wordgrams.SHINGLE_WORDS
) -> Column:
    """Condition on the column ``text``: it contains none of the items."""
    blocks = (spark.sparkContext.broadcast(block) for block in _blocks(spark, benchmark, k))
    return reduce(Column.__and__, (_clean(block, least) for block in blocks), F.lit(True))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return contained_items(inputs.table(spark, sf_dir, "documents"), inputs.table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no benchmark item."""
    return docs.where(clean_column(spark, inputs.table(spark, sf_dir, "benchmark")))


OP8_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS copy, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS copy, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
lengths AS (SELECT DISTINCT least(len(w), 5) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, copy, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d, lengths WHERE len(w) >= k),
bs AS (SELECT DISTINCT item_id, copy, least(len(w), 5) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
sized AS (SELECT item_id, copy, count(*) AS n FROM bs GROUP BY ALL)
SELECT doc_id, bs.item_id, CAST(n AS INTEGER) AS item_shingles, CAST(count(*) AS INTEGER) AS shared, CAST(count(*) AS DOUBLE) / n AS containment
FROM ds JOIN bs USING (k, s) JOIN sized ON sized.item_id = bs.item_id AND sized.copy = bs.copy
GROUP BY doc_id, ds.copy, bs.item_id, bs.copy, n
HAVING count(*) >= 0.8 * n
"""
