"""Quality classifier: a regularised quadratic discriminant over document statistics.

Every text is described by ``FEATURES`` statistics, transformed so that each class is
roughly normal. Per class the engine gathers counts, sums and sums of products (one
aggregation over all labelled rows; the driver receives one row per class). The
covariances are shrunk towards the pooled one and towards a sphere, and factored once;
the score of a text is the logistic of the difference of the two log-densities, from
Mahalanobis distances through the cached Cholesky factors.

Edge cases: null texts are empty; an empty text gets the statistics of no characters and
is scored like any other. Labelled rows with a null id or label are ignored; of several
labels of one document the largest counts. If a class has no labelled row, every score is
0.5. Rows that repeat are scored each; other columns of the input pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import inputs, wordgrams

FEATURES = (
    "length", "letters", "capitals", "digits", "symbols", "symbol_runs", "exclamations", "stops",
    "spaces", "lines", "word_length", "adjacent_repeats", "distinct_words",
)
THRESHOLD = 0.7


@dataclass(frozen=True)
class Shrinkage:
    """Weights of the pooled covariance and of the sphere, and the least variance of a statistic."""

    pooled: float = 0.1
    sphere: float = 0.02
    floor: float = 1e-4


@dataclass(frozen=True)
class Model:
    """Per class: mean, inverse Cholesky factor, log-determinant and log-prior; None if unfit."""

    means: np.ndarray | None = None
    whiten: np.ndarray | None = None
    constants: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), 0.5)
        log = [
            c - 0.5 * np.sum(((x - m) @ w.T) ** 2, axis=1)
            for m, w, c in zip(self.means, self.whiten, self.constants, strict=True)
        ]
        return 1.0 / (1.0 + np.exp(-np.clip(log[1] - log[0], -500, 500)))


def _per_text(mask: np.ndarray, begins: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return (total[begins[1:]] - total[begins[:-1]]).astype(float)


_WORD, _UPPER, _DIGIT, _SPACE, _STOP, _COMMA = 1, 2, 4, 8, 16, 32


def _kinds(points: np.ndarray) -> np.ndarray:
    """A bit set for every code point; beyond Latin, letters count as words without case."""
    letter = wordgrams.word_table()[points]
    digit = (points >= 48) & (points <= 57)
    upper = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
    space = (points == 32) | ((points >= 9) & (points <= 13)) | (points == 0xA0)
    stop = (points == 46) | (points == 63)
    comma = (points == 44) | (points == 59) | (points == 58) | (points == 39) | (points == 45)
    out = letter * np.uint8(_WORD)
    for mask, bit in ((upper, _UPPER), (digit, _DIGIT), (space, _SPACE), (stop, _STOP), (comma, _COMMA)):
        out |= mask * np.uint8(bit)
    return out


def _chunk(texts: list[str]) -> np.ndarray:
    points, begins = wordgrams.code_points(texts)
    kinds = _kinds(points)
    n = np.diff(begins).astype(float)
    letters = _per_text(kinds & _WORD > 0, begins)
    symbol = kinds == 0
    pair = np.concatenate((symbol[1:] & symbol[:-1], [False])) if len(points) else symbol
    hashes, word_begins = wordgrams.words(texts)
    counts = np.diff(word_begins)
    same = np.concatenate((hashes[1:] == hashes[:-1], [False])) if len(hashes) else np.zeros(0, bool)
    if len(hashes):
        same[word_begins[1:][counts > 0] - 1] = False
    owner = np.repeat(np.arange(len(texts)), counts)
    distinct = np.bincount(owner[_first_of(hashes, owner)], minlength=len(texts)) if len(hashes) else np.zeros(len(texts))
    some, some_words = np.maximum(n, 1), np.maximum(counts, 1)
    many, many_words, many_letters = n + 100, counts + 20, letters + 100  # so that one odd word of a short text says little
    part = lambda count, of=many: np.log1p(100.0 * count / of)
    return np.column_stack([
        np.log1p(n),
        letters / some,
        part(_per_text(kinds & _UPPER > 0, begins), many_letters),
        part(_per_text(kinds & _DIGIT > 0, begins)),
        part(_per_text(symbol, begins)),
        part(_per_text(pair, begins)),
        part(_per_text(points == 33, begins)),
        part(_per_text(kinds & _STOP > 0, begins), many_words),
        _per_text(kinds & _SPACE > 0, begins) / some,
        part(_per_text(points == 10, begins), many_words),
        np.log1p(letters / some_words),
        part(_per_text(same, word_begins), many_words),
        np.log((1.0 + distinct) / (1.0 + counts)),
    ])


def _first_of(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Positions that hold the first of the equal words of a text."""
    key = wordgrams.mix64(owner.astype(np.uint64)) ^ hashes
    return np.unique(key, return_index=True)[1]


def statistics(texts: list[str]) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    rows = [_chunk(texts[a:b]) for a, b in wordgrams.slices(texts)]
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def feature_column(text: str = "text") -> Column:
    """The statistics of a text column, as an array."""

    def of(column: pa.Array) -> pa.Array:
        x = statistics(_texts(column))
        return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())

    return F.arrow_udf(of, "array<double>")(F.col(text))


def score_column(model: Model, text: str = "text") -> Column:
    """The score of a text column, straight from the texts."""

    def of(column: pa.Array) -> pa.Array:
        return pa.array(model.score(statistics(_texts(column))))

    return F.arrow_udf(of, "double")(F.col(text))


def score_of_features(model: Model, features: str = "features") -> Column:
    """The score from an array of statistics."""

    def of(column: pa.Array) -> pa.Array:
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return pa.array(model.score(flat.reshape(len(column), len(FEATURES))))

    return F.arrow_udf(of, "double")(F.col(features))


def fit(features: DataFrame, labels: DataFrame, shrink: Shrinkage = Shrinkage()) -> Model:
    """Learn from ``features`` (doc_id, features) and ``labels`` (doc_id, label 0 or 1).

    All labelled rows count. What reaches the driver is one row per class: the number of
    rows, the sums and the sums of products of the statistics.
    """
    p = len(FEATURES)
    labels = (
        labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    x = [F.col("features")[i] for i in range(p)]
    sums = [F.sum(x[i]) for i in range(p)] + [F.sum(x[i] * x[j]) for i in range(p) for j in range(i, p)]
    rows = features.join(labels, "doc_id").groupBy("label").agg(F.count("*").alias("n"), F.array(*sums).alias("sums")).collect()
    of = {r["label"]: (r["n"], np.array(r["sums"])) for r in rows}
    if len(of) < 2:
        return Model()
    means, covs, counts = [], [], []
    upper = np.triu_indices(p)
    for label in (0, 1):
        n, s = of[label]
        mean, square = s[:p] / n, np.zeros((p, p))
        square[upper] = s[p:] / n
        square = square + np.triu(square, 1).T
        means.append(mean)
        covs.append(square - np.outer(mean, mean))
        counts.append(n)
    pooled = (covs[0] * counts[0] + covs[1] * counts[1]) / sum(counts)
    whiten, constants = [], []
    for cov, n in zip(covs, counts, strict=True):
        cov = (1 - shrink.pooled - shrink.sphere) * cov + shrink.pooled * pooled + shrink.sphere * np.diag(np.diag(pooled))
        factor = np.linalg.cholesky(cov + shrink.floor * np.eye(p))
        whiten.append(np.linalg.inv(factor))
        constants.append(-np.sum(np.log(np.diag(factor))) + np.log(n / sum(counts)))
    return Model(np.array(means), np.array(whiten), np.array(constants))


def op10_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels are learnt where the fold is not 2 of 4."""
    from ledgerloom.plans.scratch import written

    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", "text")
    features = written(docs.select("doc_id", feature_column().alias("features")), "quality")
    labels = inputs.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = fit(features, labels.where(inputs.fold("doc_id", 4) != 2))
    score = features.select(
        "doc_id", F.coalesce(inputs.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), score_of_features(model).alias("score")
    )
    return score.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose score reaches the threshold; learns from all labels of these documents."""
    labels = inputs.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = fit(docs.select("doc_id", feature_column().alias("features")), labels)
    return docs.where(score_column(model) >= THRESHOLD)
