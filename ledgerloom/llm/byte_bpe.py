"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

``encode`` cuts each text by a pattern and encodes every match on its own by a file of
ranks. The vocabulary's bytes are written as characters through the usual table of 256
printable characters, so that the library's character merges are byte merges; every way to
split a token into two others is a merge, in the order of ranks. Distinct matches are
encoded once per batch and kept in a bounded cache. ``decode`` goes back through the byte
table; bytes of one character that lie in several tokens are joined before any text is
read from them.

Edge cases: a null text is empty and has no ids; a null list of ids decodes to null; ids
outside the vocabulary and null ids decode to the bytes of U+FFFD. Columns named in
``keep`` pass through; others of the same name as an output column are dropped.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, models, pre_tokenizers

from ledgerloom.llm import inputs, wordgrams

RANKS = "byte_bpe_50k.tiktoken"
CACHED_CHARS = 4_000_000
MAX_CHARS = 400_000
PIECE_ROWS = 500
MAX_TOKENS = 300_000
_UNKNOWN = "�".encode()


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteTable:
    """The bytes of every id: what decoding needs of a vocabulary."""

    def __init__(self, path: str) -> None:
        ranks = read_ranks(path)
        self.size = max(ranks.values()) + 1
        tokens = [_UNKNOWN] * (self.size + 1)  # the last stands for any id outside
        for t, r in ranks.items():
            tokens[r] = t
        self.lengths = np.array([len(t) for t in tokens])
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes one after the other, and where each token's begin (one more at the end)."""
        ids = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        counts = self.lengths[ids]
        return self.bytes[_ranges(self.starts[ids], counts)], np.concatenate(([0], np.cumsum(counts)))

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per token the characters it has bytes of: first, and one after the last.

        Tokens that share a character both cover it.
        """
        data, begins = self.decode(ids)
        character = np.cumsum((data & 0xC0) != 0x80) if len(data) else np.zeros(0, np.int64)
        return character[begins[:-1]] - 1, character[begins[1:] - 1]


class Codec:
    """A vocabulary with its library tokenizer and a cache of encoded matches."""

    def __init__(self, path: str) -> None:
        ranks = read_ranks(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        of = byte_characters()
        spell = {t: "".join(of[b] for b in t) for t in ranks}
        merges = [
            (spell[t[:i]], spell[t[i:]])
            for t in sorted(ranks, key=ranks.__getitem__)
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        self.tokenizer = Tokenizer(models.BPE(vocab={spell[t]: r for t, r in ranks.items()}, merges=merges, cache_capacity=0))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.cached_chars = 0
        self.ids = np.zeros(0, np.int32)
        self.id_starts, self.id_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, matches: list[str]) -> None:
        """Put the matches that are not cached into the cache; empty it first if it is full."""
        if self.cached_chars > CACHED_CHARS:
            self.forget()
        new = list(set(matches) - self.at.keys())
        if not new:
            return
        found = [e.ids for e in self.tokenizer.encode_batch(new, add_special_tokens=False)]
        counts = np.array([len(x) for x in found])
        starts = len(self.ids) + np.concatenate(([0], np.cumsum(counts)[:-1]))
        self.ids = np.concatenate((self.ids, np.array([i for x in found for i in x], np.int32)))
        self.id_starts, self.id_counts = np.concatenate((self.id_starts, starts)), np.concatenate((self.id_counts, counts))
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.cached_chars += sum(map(len, new))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin (one more at the end)."""
        found = [self.pattern.findall(t) for t in texts]
        matches = [m for x in found for m in x]
        self._learn(matches)
        which = np.fromiter(map(self.at.__getitem__, matches), np.int64, len(matches))
        counts = self.id_counts[which]
        ends = np.concatenate(([0], np.cumsum(counts)))
        begins = ends[np.concatenate(([0], np.cumsum([len(x) for x in found])))]
        return self.ids[_ranges(self.id_starts[which], counts)], begins


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one range after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


@cache
def codec(path: str) -> Codec:
    """One codec per worker process and vocabulary."""
    return Codec(path)


@cache
def byte_table(path: str) -> ByteTable:
    """One byte table per worker process and vocabulary; a worker that only decodes has no more than this."""
    return ByteTable(path)


def encode(
    df: DataFrame, keep: Sequence[str], text: str = "text", path: str | None = None, offsets: bool = False, decoded: bool = False
) -> DataFrame:
    """``keep`` and the ids of ``text``.

    With ``offsets`` also the characters of each token, from ``start`` up to ``end``; with
    ``decoded`` also the bytes that the ids decode to, by the same byte table as ``decode``
    but without a second pass through Python.
    """
    path = path or public_tokenizers.path(RANKS)
    keep = [c for c in keep if c not in (text, "ids", "start", "end", "decoded")]
    ints = T.ArrayType(T.IntegerType(), False)
    added = ["ids", *["start", "end"] * offsets]
    fields = [T.StructField(n, ints) for n in added] + [T.StructField("decoded", T.BinaryType())] * decoded
    schema = T.StructType(df.select(*keep).schema.fields + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = codec(path), byte_table(path)
        for batch in batches:
            for a, texts in _pieces(batch):
                ids, begins = own.encode(texts)
                lists = [ids]
                if offsets:
                    edge = [table.offsets(ids[i:j]) for i, j in zip(begins[:-1], begins[1:], strict=True)]
                    lists += [np.concatenate([e[k] for e in edge]) for k in (0, 1)]
                arrays = [pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(x, pa.int32())) for x in lists]
                if decoded:
                    data, at = table.decode(ids)
                    arrays.append(_binary(data, at[begins]))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, len(texts)).columns[:-1], *arrays], names=schema.names)
        own.forget()  # an idle worker need not hold what it has seen

    return df.select(*keep, text).mapInArrow(run, schema)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """The texts in a batch's last column, so many rows at a time as have ``MAX_CHARS`` characters, with the first row's number."""
    column = batch.column(batch.num_columns - 1)
    for first in range(0, len(column), PIECE_ROWS):
        texts = [t or "" for t in column.slice(first, PIECE_ROWS).to_pylist()]
        for a, b in wordgrams.slices(texts, MAX_CHARS):
            yield first + a, texts[a:b]


def _binary(data: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(data)])


def decode(df: DataFrame, keep: Sequence[str], ids: str = "ids", path: str | None = None) -> DataFrame:
    """``keep`` (which may hold ``ids``) and the bytes that the ids stand for, as ``decoded``."""
    path = path or public_tokenizers.path(RANKS)
    keep = [c for c in keep if c not in (ids, "decoded")] + [ids] * (ids in keep)
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("decoded", T.BinaryType())])
    own_ids = ids in keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_table(path)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            counts = np.asarray(column.value_lengths().fill_null(0))
            a = 0
            while a < len(counts):  # so many rows that MAX_TOKENS is not passed, one at least
                b = a + max(1, int(np.searchsorted(np.cumsum(counts[a:]), MAX_TOKENS, "right")))
                part = column.slice(a, b - a)
                data, begins = own.decode(part.flatten().fill_null(-1).to_numpy(zero_copy_only=False))
                decoded = _binary(data, begins[np.concatenate(([0], np.cumsum(counts[a:b])))])
                if part.null_count:
                    decoded = pa.compute.if_else(part.is_valid(), decoded, None)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[: len(keep)], decoded], names=schema.names)
                a = b

    source = df.select(*keep) if own_ids else df.select(*keep, ids)
    return source.mapInArrow(run, schema)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    docs = inputs.table(spark, sf_dir, "documents")
    both = encode(docs, ["doc_id"], decoded=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the digest of the bytes that they decode to."""
    both = encode(docs, ["doc_id"], decoded=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
