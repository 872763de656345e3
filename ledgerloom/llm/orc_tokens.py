"""Token ids written as ORC files in the order of document ids, and read back.

Texts are dealt out by ranges of ids and sorted within them, so files and the rows in
them stand in ascending order. A task encodes the texts as they pass and writes one file:
per document its id, the ids before it in that file (``file_start``), its number of tokens and the
tokens, the last of which is ``end``. ORC cuts a file into stripes, packs the integers by
run lengths, keeps the least and largest value of every stripe and every ``ROW_INDEX`` rows,
and a Bloom filter of the document ids for each of these. So one file is read by several
tasks, stripe by stripe, and a search for some ids skips files, stripes and rows by metadata
alone (``lookup``). How many ids stand before a file follows from one row per file.

The library's tokenizer normalises and splits at white space first, and no match spans any, so
each distinct stretch between ASCII white space is encoded once and remembered, up to a bound;
capitals of ASCII and Latin-1 are folded before, as the tokenizer does, and closing marks are encoded apart.

Edge cases: a null or empty text has only the end id. A null id comes first; rows with equal ids
stand in order of their texts' hashes, and repeated rows are documents of their own. Texts
that hold a special token's string are ordinary text. An empty table gives no rows. Other
columns are not read, whatever their names. A very long text, or one without white space,
is one row's work.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import inputs
from ledgerloom.llm.byte_bpe import byte_characters
from ledgerloom.plans.scratch import fresh_folder, written

VOCABULARY = "word_bpe_49k.json"
END = 1
ROW_INDEX = 2_000
STRIPE_BYTES = 8 << 20
PIECE_BYTES = 4_000_000
CACHED = 500_000
#: Marks that the vocabulary's pattern never splits from each other, and always from a letter or digit before them: all of ASCII but the apostrophe.
MARKS = string.punctuation.replace("'", "")
#: Lower-case letters that are their own normal form.
LETTERS = "a-zß-öø-ÿ"
#: Stretches whose normal form is their lower case.
FOLDED = r"^[\x00-\x7FÀ-ÖØ-öø-ÿ]*$"
CLOSED = rf"^.*[{LETTERS}0-9]([{re.escape(MARKS)}]+)$"
#: Letters beyond ASCII as the characters that stand for their bytes.
SPELT = {ord(c): "".join(byte_characters()[b] for b in c.encode()) for c in map(chr, range(0xDF, 0x100))}
BROADCAST_FILES = 100_000
WRITTEN = "doc_id long, file_start long, n_tokens long, ids array<int>"


class Encoder:
    """A vocabulary's tokenizer, with the ids of the pieces of text that it has met."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.lists = pa.array([], pa.list_(pa.int32()))

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Where in ``lists`` each of these distinct pieces is."""
        if len(self.at) > CACHED:
            self.forget()
        where = np.fromiter(map(self.at.get, pieces, repeat(-1)), np.int64, len(pieces))
        unknown = np.flatnonzero(where < 0)
        if len(unknown):
            new = [pieces[i] for i in unknown.tolist()]
            # lower-case letters of Latin-1 are their own normal form and one match, so the model alone encodes them, spelt byte by byte
            letters = _listed(pc.match_substring_regex(pa.array(new, pa.string()), f"^[{LETTERS}]+$"))
            other = iter(self.tokenizer.encode_batch_fast([x for x, own in zip(new, letters, strict=True) if not own], add_special_tokens=False))
            model = self.tokenizer.model
            found = [[t.id for t in model.tokenize(x if x.isascii() else x.translate(SPELT))] if own else next(other).ids for x, own in zip(new, letters, strict=True)]
            begins = np.concatenate(([0], np.cumsum([len(x) for x in found])))
            ids = np.fromiter((i for x in found for i in x), np.int32, begins[-1])
            where[unknown] = np.arange(len(self.lists), len(self.lists) + len(new))
            self.at.update(zip(new, where[unknown].tolist(), strict=True))
            self.lists = pa.concat_arrays([self.lists, _lists(ids, begins)])
        return where

    def encode(self, texts: pa.Array, end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin (one more at the end); ``end`` closes every text."""
        lists = pc.ascii_split_whitespace(texts)
        codes = lists.flatten().dictionary_encode()
        plain = codes.dictionary
        plain = pc.if_else(pc.match_substring_regex(plain, FOLDED), pc.utf8_lower(plain), plain)
        bare = pc.ascii_rtrim(plain, characters=MARKS)
        closed = pc.and_(pc.not_equal(bare, plain), pc.match_substring_regex(bare, f"[{LETTERS}0-9]$"))
        body = pc.if_else(closed, bare, plain)
        tail = pc.replace_with_mask(pa.repeat(pa.scalar("", plain.type), len(plain)), closed, pc.replace_substring_regex(plain.filter(closed), CLOSED, r"\1"))
        both = pa.concat_arrays([body, tail]).dictionary_encode()
        where = self._learn(_listed(both.dictionary))[both.indices.to_numpy()]
        pairs = self.lists.take(pa.array(where.reshape(2, -1).T.ravel()))  # a stretch's body, then its marks
        begins = np.concatenate(([0], np.cumsum(pairs.value_lengths().to_numpy())))[::2]
        closing = [] if end is None else [end]
        stretches = _lists(np.concatenate((pairs.flatten().to_numpy(), np.array(closing, np.int32))), np.concatenate((begins, begins[-1:] + 1)) if closing else begins)
        which, edges = codes.indices.to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        if closing:
            which, edges = np.insert(which, edges[1:], len(plain)), edges + np.arange(len(edges))
        out = stretches.take(pa.array(which))
        return out.flatten().to_numpy(), np.concatenate(([0], np.cumsum(out.value_lengths().to_numpy())))[edges]


def _lists(values: np.ndarray, begins: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(values, pa.int32()))


def _listed(values: pa.Array) -> list:
    """``values`` without nulls as a list; several times as fast as one by one."""
    return values.to_numpy(zero_copy_only=False).tolist()


@cache
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    return Encoder(path)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most ``PIECE_BYTES`` of text, or one row."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE_BYTES, "right")))
        yield batch.slice(a, b - a)
        a = b


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in partitions of ascending ids; a much repeated id is split by its texts' hashes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), inputs.whole_text().alias("text")).withColumn("hash", F.xxhash64("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # so that even one row, repeated, can be split
    by = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END, stripe_bytes: int = STRIPE_BYTES, row_index: int = ROW_INDEX) -> None:
    """Encodes ``docs`` (doc_id, text) and writes them to ``folder``."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start = encoder(path), 0
        for batch in batches:
            for piece in _pieces(batch):
                ids, begins = own.encode(piece.column("text"), end)
                columns = [piece.column("doc_id"), pa.array(start + begins[:-1], pa.int64()), pa.array(np.diff(begins), pa.int64()), _lists(ids, begins)]
                start += len(ids)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "file_start", "n_tokens", "ids"])

    options = {
        "orc.compress": "ZSTD", "orc.stripe.size": stripe_bytes, "orc.row.index.stride": row_index, "orc.create.index": "true",
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01,
    }
    in_order(docs).mapInArrow(run, WRITTEN).write.options(**options).orc(folder)


def read_tokens(spark: SparkSession, folder: str, columns: Sequence[str] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """The documents in ``folder``; ``start`` is the number of ids of all documents before."""
    own = [c for c in columns if c != "start"]
    rows = spark.read.schema(WRITTEN).orc(folder)
    if "start" not in columns:
        return rows.select(*own)
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")  # files are numbered in order
    files = rows.groupBy(number.alias("file")).agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = written(files.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before")), "files")
    few = offsets.count() <= BROADCAST_FILES
    joined = rows.withColumn("file", number).join(F.broadcast(offsets) if few else offsets, "file")
    return joined.select(*(F.col("before") + F.col("file_start") if c == "start" else F.col(c) for c in columns)).toDF(*columns)


def lookup(spark: SparkSession, folder: str, doc_ids: Sequence[int]) -> DataFrame:
    """(doc_id, n_tokens, ids) of some documents; by statistics and Bloom filters only the groups of rows that may hold them are read."""
    return read_tokens(spark, folder, ("doc_id", "n_tokens", "ids")).where(F.col("doc_id").isin([int(i) for i in doc_ids]))


def with_checksum(tokens: DataFrame, name: str = "ids_crc32") -> DataFrame:
    """``tokens`` with the CRC-32 of its ids as unsigned little-endian numbers of 32 bits in their place."""
    kept = [c for c in tokens.columns if c not in ("ids", name)]
    schema = tokens.select(*kept, F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            data = memoryview(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))) * 4
            sums = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], names=schema.names)

    return tokens.select(*kept, "ids").mapInArrow(run, schema)


def op11_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the files."""
    folder = fresh_folder(spark, "tokens")
    write_tokens(inputs.table(spark, sf_dir, "documents"), folder)
    return with_checksum(read_tokens(spark, folder))
