"""Restoring words from leetspeak, spacing and repetition: Viterbi over a character lattice.

A *suspect* is a token in which a look-alike character touches a letter, a run of single
characters (letters and look-alikes, at least one a letter) set apart by one or more spaces,
dots, dashes or underscores, or a letter three times or more in a row. Each of its characters
gives one step of a lattice: the letters that it may stand for, each with a cost, and within
a run of three or more equal characters the choice to drop it; where the characters are set
apart, a word may end between two of them. The cheapest path under a trigram character
model, from the word's start to its end, is the restored word. As signs around a word may be
punctuation or letters, a token is read from each of its leading signs on (the first and the
last ``EDGE`` of them), up to each of its trailing ones, and a spaced one also without any
sign; of these readings the one that is cheapest by the letter stands in the restored text.

Full-width letters and signs are read as the ASCII ones. Letters of other alphabets that look
like Latin ones count as look-alikes in tokens that have Latin letters as well. Letters that the
model does not know stay as they are. A token of any length is decoded as one lattice.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache

import numpy as np

from ledgerloom.llm import wordgrams

ALPHABET = " abcdefghijklmnopqrstuvwxyzßàáâäçèéêëíîïñóôöúùûü'абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
SIZE = len(ALPHABET)
AT = {c: i for i, c in enumerate(ALPHABET)}
#: Which letters a character may stand for; fixed values.
LOOKALIKES = {
    "0": "ou", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
#: Letters of other alphabets that look like Latin ones; fixed values.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "і": "i", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
SWAP_COST, DROP_COST, SPLIT_COST = 1.0, 0.5, 1.0
EDGE = 8
SIGNS = "".join(c for c in LOOKALIKES if not c.isalnum())
_SEPARATED = re.compile(r"[ .\-_]")
_WIDE = re.compile("[\uff01-\uff5e\u3000]")
_NARROW = {0xFF01 + i: 0x21 + i for i in range(0x5E)} | {0x3000: 0x20}
_SIGNED = re.compile(f"[{re.escape(SIGNS)}]")


def codes(text: str) -> np.ndarray:
    """The alphabet's numbers of a lower-case text, all other characters as the boundary."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    return _table()[np.minimum(points, len(_table()) - 1)]


@cache
def _table() -> np.ndarray:
    return np.array([AT.get(chr(i), 0) for i in range(max(map(ord, ALPHABET)) + 1)] + [0], np.int64)


def narrow(text: str) -> str:
    """``text`` with full-width letters and signs as the ASCII ones; as long as before."""
    return text.translate(_NARROW) if _WIDE.search(text) else text


def trigram_counts(texts: list[str]) -> np.ndarray:
    """How often each trigram of alphabet numbers occurs, at ``a * SIZE**2 + b * SIZE + c``; boundaries do not repeat."""
    c = codes(" " + "\n".join(texts).lower() + " ")
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    # a word is preceded by two boundaries: each boundary is doubled
    c = np.repeat(c, np.where(c == 0, 2, 1))
    return np.bincount(c[:-2] * SIZE * SIZE + c[1:-1] * SIZE + c[2:], minlength=SIZE**3)


class CharacterModel:
    """Costs (negative log-probabilities) of a character after two others, with backing off to one and none."""

    def __init__(self, counts: np.ndarray) -> None:
        three = np.asarray(counts, float).reshape(SIZE, SIZE, SIZE)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 1) / (one.sum() + SIZE)
        p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
        p3 = (three + 5 * p2) / (three.sum(2, keepdims=True) + 5)
        self.cost = -np.log(p3)

    def restore(self, token: str) -> str:
        """The cheapest reading of a whole token in lower case, without separators."""
        text = _SEPARATED.sub("", token.lower())
        return self._endings(text, len(text)).popitem()[0]

    def readings(self, token: str) -> dict[str, float]:
        """The cheapest readings of a token with and without the signs around it, and what they cost by the letter.

        A reading may be several words where the token's characters are set apart.
        """
        text = token.lower()
        out: dict[str, float] = {}
        texts, apart = {text}, bool(_SEPARATED.search(text))
        if apart:
            text = _SEPARATED.sub("", text)
            texts = {text, _SIGNED.sub("", text)}
        for t in texts - {""}:
            first, last = len(t) - len(t.lstrip(SIGNS)), len(t.rstrip(SIGNS))
            first = min(first, last)
            for a in sorted({*range(min(EDGE, first) + 1), *range(max(first - EDGE, 0), first + 1)}):
                out |= self._endings(t[a:], max(last - a, 1))
        if apart and text:
            out |= self._endings(text, len(text), split=True)
        return out

    def _endings(self, text: str, least: int, split: bool = False) -> dict[str, float]:
        """The cheapest readings of the text's beginnings of ``least`` characters or more (the first and last ``EDGE`` of them), with their costs by the letter."""
        # state: the last two letters -> (cost, path); the number of states is bounded by the look-alikes' letters
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        out: dict[str, float] = {} if text else {"": 0.0}
        mixed = any("a" <= c <= "z" for c in text)
        n = len(text)
        for i, c in enumerate(text):
            options = [(AT.get(c, 0), c, 0.0)] if c in AT and c != " " or c.isalpha() else []
            options += [(AT[x], x, SWAP_COST) for x in LOOKALIKES.get(c, "")]
            if mixed and c in HOMOGLYPHS:
                options.append((AT[HOMOGLYPHS[c]], HOMOGLYPHS[c], SWAP_COST / 4))
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            droppable = i > 0 and text[i - 1] == c and (text[i - 2 : i + 1] == c * 3 or text[i - 1 : i + 2] == c * 3)
            begun = states
            if split and i:  # a word may end before this character
                end = min(((cost + self.cost[a, b, 0] + SPLIT_COST, path) for (a, b), (cost, path) in states.items()), key=lambda x: x[0])
                if (0, 0) not in states or end[0] < states[0, 0][0]:
                    begun = states | {(0, 0): (end[0], (end[1], " "))}
            for (a, b), (cost, path) in begun.items():
                for m, x, extra in options:
                    new = cost + extra + self.cost[a, b, m]
                    if (b, m) not in after or new < after[b, m][0]:
                        after[b, m] = (new, (path, x))
                if droppable or not options:
                    new = cost + DROP_COST
                    if (a, b) not in after or new < after[a, b][0]:
                        after[a, b] = (new, path)
            states = after
            if i + 1 >= least and (i + 1 - least <= EDGE or n - i - 1 <= EDGE):
                cost, path = min(((cost + self.cost[a, b, 0], path) for (a, b), (cost, path) in states.items()), key=lambda x: x[0])
                word = _spelt(path)
                out[word] = cost / (len(word) + 1)
        return out


def _spelt(path: tuple | None) -> str:
    letters = []
    while path is not None:
        path, x = path
        letters.append(x)
    return "".join(reversed(letters))


@cache
def _look_table() -> np.ndarray:
    out = np.zeros(max(map(ord, LOOKALIKES)) + 2, bool)
    out[[ord(c) for c in LOOKALIKES]] = True
    return out


@cache
def _twin_table() -> np.ndarray:
    out = np.zeros(max(map(ord, HOMOGLYPHS)) + 2, bool)
    out[[ord(x) for c in HOMOGLYPHS for x in (c, c.upper())]] = True
    return out


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true begin and end."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def suspects(texts: list[str]) -> list[list[str]]:
    """The suspect tokens of each text."""
    return [[t[x:y] for x, y in own] for t, own in zip(texts, suspect_spans(texts), strict=True)]


def suspect_spans(texts: list[str]) -> list[list[tuple[int, int]]]:
    """Where the suspect tokens of each text begin and end; spans may overlap."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b in wordgrams.slices(texts):
        sizes = [len(t) + 1 for t in texts[a:b]]
        begins = np.cumsum([0, *sizes]).tolist()
        for d, x, y in _suspects("\n".join(texts[a:b]), sizes):
            out[a + d].append((x - begins[d], y - begins[d]))
    return out


def _suspects(joined: str, sizes: list[int]) -> Iterable[tuple[int, int, int]]:
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    if len(points) < 2:
        return
    letter = wordgrams.word_table()[points] & ~((points >= 48) & (points <= 57))
    look = _look_table()[np.minimum(points, len(_look_table()) - 1)]
    hit = np.zeros(len(points), bool)
    hit[:-1] = look[:-1] & letter[1:]
    hit[1:] |= look[1:] & letter[:-1]
    latin = (points < 0x250) & letter
    twin = _twin_table()[np.minimum(points, len(_twin_table()) - 1)]
    hit[:-1] |= (twin[:-1] & latin[1:]) | (latin[:-1] & twin[1:])
    hit[:-2] |= letter[:-2] & (points[:-2] == points[1:-1]) & (points[1:-1] == points[2:])
    begin, end = _runs(letter | look)
    which = np.unique(np.searchsorted(begin, np.flatnonzero(hit), "right") - 1)
    spans = [(begin[which], end[which]), _spaced(points, letter, begin, end)]
    begins = np.cumsum([0, *sizes])
    for first, last in spans:
        for x, y, d in zip(first.tolist(), last.tolist(), (np.searchsorted(begins, first, "right") - 1).tolist(), strict=True):
            yield d, x, y


def _spaced(points: np.ndarray, letter: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of three or more single characters (with signs beside them, or signs alone) begin and end.

    Wider gaps may part words: a run is also cut at the gaps wider than each width that occurs in it.
    """
    total = lambda x: np.concatenate(([0], np.cumsum(x)))
    letters = total(letter)
    signs = total(~(letter | ((points >= 48) & (points <= 57))))
    gaps = total((points == 32) | (points == 46) | (points == 45) | (points == 95))
    single = (end - begin) - (signs[end] - signs[begin]) <= 1
    width = begin[1:] - end[:-1]
    tied = single[:-1] & single[1:] & (gaps[begin[1:]] - gaps[end[:-1]] == width)
    found = []
    for first, last in zip(*_runs(tied), strict=True):
        if last - first < 2 or letters[end[last]] == letters[begin[first]]:
            continue
        own = width[first:last]
        for most in np.unique(own):
            for a, b in zip(*_runs(own <= most), strict=True):
                if b - a >= 2 and letters[end[first + b]] > letters[begin[first + a]]:
                    found.append((begin[first + a], end[first + b]))
    found = sorted(set(found))
    return np.array([x for x, _ in found], np.int64), np.array([y for _, y in found], np.int64)
