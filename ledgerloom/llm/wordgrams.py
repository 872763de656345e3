"""Words, shingles and minimum hashes of many texts at once, as numpy arrays.

The functions work on plain lists of texts inside a task. Words are maximal runs of
letters and digits (Unicode categories L and N) of the lower-cased text. A shingle is the
64-bit hash of ``k`` consecutive words; a text of one to ``k - 1`` words has one shingle,
made of all its words; a text without words has none.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

SHINGLE_WORDS = 5
MAX_CHARS = 1_000_000

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def word_table() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(i))[0] in "LN" for i in range(sys.maxunicode + 1)), dtype=bool)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return (np.cumprod(np.full(size, _BASE, np.uint64)), np.cumprod(np.full(size, _INVERSE, np.uint64)))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, for positions below ``n``."""
    size = 1 << max(20, int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def slices(texts: list[str], max_chars: int = MAX_CHARS) -> Iterator[tuple[int, int]]:
    """Cut a list into runs of at most ``max_chars`` characters; a longer text stands alone."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > max_chars:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after the other, and where each text begins (one more at the end)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    return points, np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def prefix_hash(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which ``span_hash`` gets the hash of any span of the array."""
    up, down = powers(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix64(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=total[1:])
    return total, down


def span_hash(prefix: tuple[np.ndarray, np.ndarray], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total, down = prefix
    return mix64((total[end] - total[begin]) * down[begin])


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and where each text's words begin (one more at the end)."""
    points, begins = code_points([t.lower() for t in texts])
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = word_table()[points]
    cut = np.zeros(len(points) + 1, bool)
    cut[begins] = True
    before = np.concatenate(([False], inside[:-1])) & ~cut[:-1]
    after = np.concatenate((inside[1:], [False])) & ~cut[1:]
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return span_hash(prefix_hash(points), first, last), np.searchsorted(first, begins).astype(np.int64)


def shingles(word: np.ndarray, begins: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle in order, repeats included, and where each text's shingles begin."""
    counts = np.diff(begins)
    n_docs, n = len(counts), len(word)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_begins = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(int(out_begins[-1]), np.uint64)
    if n >= k:
        rolled = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            rolled += word[j : n - k + 1 + j] * np.uint64(pow(_BASE, j + 1, 1 << 64))
        owner = np.repeat(np.arange(n_docs), counts)
        whole = owner[: n - k + 1] == owner[k - 1 :]
        long = np.repeat(counts >= k, sizes)
        out[long] = mix64(rolled[whole])
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        h = 0
        for j, w in enumerate(word[begins[d] : begins[d + 1]]):
            h = (h + int(w) * pow(_BASE, j + 1, 1 << 64)) & _MASK
        out[out_begins[d]] = mix64(np.array([h], np.uint64))[0]
    return out, out_begins


def hash_functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` functions on 32 bits, each an xor and an odd factor."""
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 32, n, dtype=np.uint32), r.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def min_hashes(values: np.ndarray, begins: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Per function and run of values (which may not be empty), the least hash; functions x runs."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(functions[0]), len(begins)), np.uint32)
    for j, (x, a) in enumerate(zip(*functions, strict=True)):
        np.minimum.reduceat((low ^ x) * a, begins, out=out[j])
    return out
