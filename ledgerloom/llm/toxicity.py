"""Toxicity: restored text scored by words and word beginnings that labelled rows show to be toxic.

The character model behind the restoration (``noisy_channel``) counts the trigrams of every
text; what reaches the driver is bounded by the alphabet. ``restored`` writes a text anew
with each suspect token in its likeliest reading (a word beside mere signs stays as it is); scored are the words of that text, and
those of the tokens' other readings. The classifier is fitted on at most ``SAMPLE`` labelled
rows, those whose ids have the least hashes. A feature is a word, or its first ``PREFIX``
characters, once per text. The weight of a feature is the log of the ratio of its
frequencies in toxic and clean rows, less ``CAUTION`` standard errors, so that rare words
need more evidence; features are hashed to ``SLOTS`` places and only those with a weight
above ``LEAST`` are kept and broadcast, at most one per place. The score of a text is a
logistic function of its largest and second largest weight. That function is fitted on the
same rows, but each half of them is seen with the weights that the other half gives.

Edge cases: a null text is empty; a text without known features has the base score; if the
sample lacks either class, every score is 0. Labelled rows with a null id or label are
ignored, of several labels of one document the largest counts. Rows may repeat, ids may be
null; the texts' other columns are never read. Empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import inputs, wordgrams
from ledgerloom.llm.noisy_channel import SIGNS, SIZE, CharacterModel, narrow, suspect_spans, trigram_counts
from ledgerloom.plans.scratch import written

SAMPLE = 20_000
SLOTS = 1 << 22
PREFIX = 4
CAUTION, LEAST = 1.5, 0.5
THRESHOLD = 0.7
CACHED_WORDS = 300_000
_WORDS = re.compile(r"[^\W\d_]+")
_PLAIN, _THRICE = re.compile(r"(?:[a-zA-Z\u00c0-\u024f]+|[^\W\d_a-zA-Z\u00c0-\u024f]+)?"), re.compile(r"([^\W\d_])\1\1")
_JOINED = re.compile(r"[ .\-_]")


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def character_model(docs: DataFrame) -> CharacterModel:
    """The trigram model of all texts; at most ``SIZE ** 3`` sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            texts = _texts(batch.column(0))
            for a, b in wordgrams.slices(texts):
                total += trigram_counts(texts[a:b])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["trigram", "n"])

    rows = docs.select("text").mapInArrow(run, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SIZE**3)
    for r in rows:
        counts[r["trigram"]] = r["n"]
    return CharacterModel(counts)


def restorations(texts: list[str], model: CharacterModel, known: dict[str, dict[str, float]]) -> Iterator[tuple[str, set[str]]]:
    """Each text with its suspect tokens in their likeliest reading, and the words of all their readings; ``known`` keeps what was read before."""
    if len(known) > CACHED_WORDS:
        known.clear()
    texts = [narrow(t) for t in texts]
    for text, spans in zip(texts, suspect_spans(texts), strict=True):
        pieces, at, read = [], 0, set()
        for x, y in sorted(spans, key=lambda s: (s[0], -s[1])):
            token = text[x:y]
            found = known.get(token)
            if found is None:
                found = known[token] = model.readings(token)
            for r in found:
                read.update(r.split())
                if _JOINED.search(token):  # the first or last letter may have been a word of its own
                    read |= {r[1:], r[:-1], r[1:-1]}
            plain = _PLAIN.fullmatch(token.strip(SIGNS)) and not _THRICE.search(token)  # a word beside punctuation
            if x >= at and found and not plain:
                pieces += [text[at:x], min(found, key=lambda r: (found[r], r))]
                at = y
        read.discard("")
        yield "".join(pieces) + text[at:] if pieces else text, read


def restored(texts: list[str], model: CharacterModel) -> list[str]:
    """The texts with what was disguised written out."""
    return [t for t, _ in restorations(texts, model, {})]


def restored_column(spark: SparkSession, model: Broadcast, text: str = "text") -> Column:
    """A text column with what was disguised written out."""

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts = _texts(column)
            yield pa.array([t for a, b in wordgrams.slices(texts) for t in restored(texts[a:b], model.value)], pa.string())

    return F.arrow_udf(of, "string")(F.col(text))


def words_of(texts: list[str], model: CharacterModel, known: dict[str, dict[str, float]]) -> Iterator[set[str]]:
    """The distinct words of each restored text in lower case, and those of other readings."""
    for text, read in restorations(texts, model, known):
        yield {*_WORDS.findall(text.lower()), *read}


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % SLOTS


def _slots(word: str) -> tuple[int, ...]:
    return (_slot(word), _slot("^" + word[:PREFIX])) if len(word) > PREFIX else (_slot(word),)


class Weights:
    """Kept features by place, and the logistic function."""

    def __init__(self, weights: dict[int, float], curve: np.ndarray) -> None:
        self.weights, self.curve, self.cached = weights, curve, {}

    def top(self, words: set[str]) -> tuple[float, float]:
        """The two largest weights of a text's words."""
        first = second = 0.0
        cached = self.cached
        if len(cached) > CACHED_WORDS:
            cached.clear()
        for w in words:
            x = cached.get(w)
            if x is None:
                x = cached[w] = max(self.weights.get(s, 0.0) for s in _slots(w))
            if x > second:
                first, second = (x, first) if x > first else (first, x)
        return first, second

    def score(self, tops: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + tops @ self.curve[1:], -40, 40)))


def _tops(model: Broadcast, weights: Broadcast, texts: list[str], known: dict[str, dict[str, float]]) -> np.ndarray:
    out = [weights.value.top(w) for a, b in wordgrams.slices(texts) for w in words_of(texts[a:b], model.value, known)]
    return np.array(out, float).reshape(len(texts), 2)


def _feature_counts(sample: DataFrame, model: Broadcast) -> DataFrame:
    """(slot, half, toxic, clean): in how many labelled rows of each half and kind a feature's place occurs, summed per partition first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = np.zeros((2, 2, SLOTS), np.int32), {}
        for batch in batches:
            texts, labels, halves = _texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in wordgrams.slices(texts):
                for label, half, words in zip(labels[a:b], halves[a:b], words_of(texts[a:b], model.value, known), strict=True):
                    own = {s for w in words for s in _slots(w)}
                    counts[half, label, np.fromiter(own, np.int64, len(own))] += 1
        for half in (0, 1):
            at = np.flatnonzero(counts[half].any(0))
            columns = [pa.array(at), pa.array(np.full(len(at), half, np.int32)), pa.array(counts[half, 1, at]), pa.array(counts[half, 0, at])]
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "half", "toxic", "clean"])

    parts = sample.select("text", "label", "half").mapInArrow(run, "slot long, half int, toxic int, clean int")
    return parts.groupBy("slot", "half").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _weights(counts: DataFrame, toxic: int, clean: int) -> dict[int, float]:
    """Weights by place from (slot, toxic, clean), of so many rows of each kind."""
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    weight = F.log(t / (toxic + 1.0)) - F.log(c / (clean + 1.0)) - CAUTION * F.sqrt(1 / t + 1 / c)
    return {r["slot"]: r["weight"] for r in counts.select("slot", weight.alias("weight")).where(F.col("weight") > LEAST).collect()}


def _curve(rows: list) -> np.ndarray:
    """Logistic regression on rows (first, second, label, n), with a light ridge, by Newton's steps."""
    x = np.array([[1.0, r[0], r[1]] for r in rows])
    y, n = np.array([float(r[2]) for r in rows]), np.array([float(r[3]) for r in rows])
    beta, ridge = np.zeros(3), np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + ridge, x.T @ (n * (y - p)) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, model: Broadcast, sample_rows: int = SAMPLE) -> Weights | None:
    """Learn from ``labels`` (doc_id, label 0 or 1) of ``docs`` (doc_id, text); None if a class is missing."""
    spark = docs.sparkSession
    labels = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(2)).cast("int"))
    sample = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label", "half"), "sample")  # so many ids at most
    sizes = {(r["half"], r["label"]): r["count"] for r in sample.groupBy("half", "label").count().collect()}
    of_half = lambda h, label: sizes.get((h, label), 0)
    if not all(of_half(0, label) + of_half(1, label) for label in (0, 1)):
        return None
    counts = written(_feature_counts(sample, model), "features")
    whole = counts.groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    weights = Weights(_weights(whole, *(of_half(0, label) + of_half(1, label) for label in (1, 0))), np.zeros(3))
    # the weights of the other half; if that lacks a class, those of all rows
    halves = [Weights(_weights(counts.where(F.col("half") == 1 - h), of_half(1 - h, 1), of_half(1 - h, 0)), np.zeros(3)) if of_half(1 - h, 1) and of_half(1 - h, 0) else weights for h in (0, 1)]
    sent = [spark.sparkContext.broadcast(w) for w in halves]

    def of(text: pa.Array, half: pa.Array) -> pa.Array:
        texts, own = _texts(text), np.array(half.to_pylist())
        tops = np.zeros((len(texts), 2))
        for h in (0, 1):
            at = np.flatnonzero(own == h)
            tops[at] = _tops(model, sent[h], [texts[i] for i in at], {})
        return pa.ListArray.from_arrays(np.arange(len(tops) + 1, dtype=np.int32) * 2, np.round(tops, 1).ravel())

    tops = sample.select("label", F.arrow_udf(of, "array<double>")("text", "half").alias("tops"))
    rows = tops.groupBy(F.col("tops")[0].alias("first"), F.col("tops")[1].alias("second"), "label").count().collect()
    weights.curve = _curve([(r["first"], r["second"], r["label"], r["count"]) for r in rows])
    weights.cached = {}
    return weights


def score_column(spark: SparkSession, model: Broadcast, weights: Weights | None, text: str = "text") -> Column:
    """The score of a text column."""
    if weights is None:
        return F.lit(0.0)
    sent = spark.sparkContext.broadcast(weights)

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, dict[str, float]] = {}
        for column in batches:
            yield pa.array(sent.value.score(_tops(model, sent, _texts(column), known)))

    return F.arrow_udf(of, "double")(F.col(text))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels are learnt where the fold is not 1 of 3."""
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = inputs.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = spark.sparkContext.broadcast(character_model(docs))
    weights = fit(docs, labels.where(inputs.fold("doc_id", 3) != 1), model)
    scored = docs.select(
        "doc_id", F.coalesce(inputs.fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), score_column(spark, model, weights).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
