"""Licence scan: parts of a text compared with licence templates by Dice over word bigrams.

The parts of a text are its lines, its paragraphs (between empty lines) and itself, equal
ones once. A part is normalised to its words, runs of ASCII letters and digits in lower
case with ``licence`` spelt ``license``, and to the set of pairs of neighbouring words. Its likeness to a template is
``2 * shared / (own + template's)``. A part of ``a`` pairs can reach the threshold t only
with templates of ``a * t / (2 - t)`` to ``a * (2 - t) / t`` pairs; others are not compared.
A text in which none of the templates' signature words occurs is not cut up at all: a
likeness of t needs more than ``t / (2 - t)`` of a template's pairs, so one word from each
of the pairs beyond that share must occur.

Besides, every window of consecutive words of the text, across its lines and paragraphs, is
compared with the templates and with the full texts of some licences. Only windows that
begin and end with a template's pair, and whose first pair does not return, can be the best
ones; they are walked where the text holds the share of the template's pairs that it needs. A
match within a longer one that another template fits better (a licence's clauses within a
licence with more of them) is left out; the best of the others names the licence.
Lines, paragraphs and texts are the parts counted as matches; where none of them matches,
the separate stretches of matching windows are counted.

The full texts of further licences, such as the GPL, may be given as a folder of files
(``read_texts``, or ``spark.ledgerloom.licenses`` for the query). They are sought by the same
rule whatever their length; of a document that repeats a licence of ``n`` words ``r`` times,
some ``r * n`` windows of up to about ``n`` words are walked.

Edge cases: a null text is empty, a very long one is one row's work, other columns are not read and
an empty table gives no rows; parts of less than two words match nothing; of equally
good templates the least name wins. Every row of the input gives one row, whatever repeats.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import inputs
from ledgerloom.llm.license_templates import FULL_TEXTS, TEMPLATES

DICE = 0.8
TEXTS_CONF = "spark.ledgerloom.licenses"
TEXTS_BYTES = 64_000_000
SCANNED = "doc_id long, license string, dice double, n_matches int"
_WORD = re.compile("[a-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
Pairs = frozenset[tuple[str, str]]


def normal(text: str) -> str:
    return text.translate(_LOWER).replace("licence", "license")


def pairs(text: str) -> Pairs:
    words = _WORD.findall(normal(text))
    return frozenset(zip(words, words[1:], strict=False))


def dice(a: Pairs, b: Pairs) -> float:
    return 2 * len(a & b) / (len(a) + len(b))


class Templates:
    """The templates' pairs in the order of their sizes, and the signature words."""

    def __init__(self, templates: Mapping[str, Sequence[str]], least: float) -> None:
        self.least = least
        self.all = sorted(((len(p), name, p) for name, texts in templates.items() for t in texts if (p := pairs(t))), key=lambda x: x[:2])
        signature = set()
        for size, _, own in self.all:
            spare = size - math.ceil(size * least / (2 - least) - 1e-9) + 1
            longest = sorted((max(p, key=lambda w: (len(w), w)) for p in own), key=lambda w: (-len(w), w))
            signature.update(longest[:spare])
        #: A word that contains another one of them need not be looked for.
        self.signature = [w for w in signature if not any(v != w and v in w for v in signature)]

        #: Which templates have a pair.
        self.having: dict[tuple[str, str], list[int]] = {}
        for i, (_, _, own) in enumerate(self.all):
            for p in own:
                self.having.setdefault(p, []).append(i)

    def windows(self, text: str) -> tuple[str | None, float | None, int]:
        """As ``scan``, over all windows of words; the count is that of separate stretches of matching windows."""
        low = normal(text)
        if not any(w in low for w in self.signature):
            return None, None, 0
        words = _WORD.findall(low)
        own = list(zip(words, words[1:], strict=False))
        tops, matching = self.top_windows(own)

        def outdone(i: int) -> bool:
            """Whether the match is but a piece of a longer one that another template fits better."""
            d, a, b = tops[i]
            return any(
                x <= a and b <= y and (x, y) != (a, b) and dice(frozenset(own[x:y]), self.all[i][2]) < e
                for j, (e, x, y) in tops.items()
                if j != i
            )

        left = [i for i in tops if not outdone(i)] or list(tops)
        best = min(((-tops[i][0], self.all[i][1]) for i in left), default=None)
        stretches, reach = 0, -1
        for begin, end in sorted(matching):
            stretches += begin > reach
            reach = max(reach, end)
        return (best[1], -best[0], stretches) if best else (None, None, 0)

    def top_windows(self, own: list[tuple[str, str]]) -> tuple[dict[int, tuple[float, int, int]], list[tuple[int, int]]]:
        """Each template's likest window of the pairs (likeness, begin, end), and all matching windows that begin at different places."""
        hits: dict[int, list[int]] = {}
        for at, p in enumerate(own):
            for i in self.having.get(p, ()):
                hits.setdefault(i, []).append(at)
        tops: dict[int, tuple[float, int, int]] = {}
        matching: list[tuple[int, int]] = []
        for i, places in hits.items():
            size, _, template = self.all[i]
            small, large = size * self.least / (2 - self.least) - 1e-9, size * (2 - self.least) / self.least + 1e-9
            if len(places) < small or len({own[at] for at in places}) < small:
                continue
            # how many of the template's pairs are left from each place on
            left, rest = [0] * len(places), set()
            for n in range(len(places) - 1, -1, -1):
                rest.add(own[places[n]])
                left[n] = len(rest)
            for n, begin in enumerate(places):
                bound = 2 * left[n] / (left[n] + size)
                if bound < self.least:
                    continue
                seen: set[tuple[str, str]] = set()
                shared, end = 0, 0
                for at in range(begin, len(own)):
                    p = own[at]
                    if p in seen:
                        if p == own[begin]:  # from the next pair on, the window holds the same
                            break
                        continue
                    seen.add(p)
                    if len(seen) > large:
                        break
                    if p in template:
                        shared += 1
                        d = 2 * shared / (len(seen) + size)
                        if d >= self.least:
                            end = at + 1
                            if i not in tops or d > tops[i][0]:
                                tops[i] = d, begin, end
                if end:
                    matching.append((begin, end))
        return tops, matching

    def scan(self, text: str) -> tuple[str | None, float | None, int]:
        """Best template, its likeness, and how many parts match any template."""
        low = normal(text)
        if not any(w in low for w in self.signature):
            return None, None, 0
        best: tuple[float, str] | None = None
        matches = 0
        for part in {*text.split("\n"), *text.split("\n\n"), text}:
            own = pairs(part)
            if not own:
                continue
            small, large = len(own) * self.least / (2 - self.least) - 1e-9, len(own) * (2 - self.least) / self.least + 1e-9
            found = [(-d, name) for size, name, t in self.all if small <= size <= large and (d := dice(own, t)) >= self.least]
            if found:
                matches += 1
                best = min(found) if best is None else min(best, min(found))
        return (best[1], -best[0], matches) if best else (None, None, 0)


def read_texts(spark: SparkSession, folder: str) -> dict[str, tuple[str, ...]]:
    """Licence texts from a folder of files, each named by its licence; refuses more than ``TEXTS_BYTES`` together, as every task holds them all."""
    files = spark.read.format("binaryFile").load(folder)
    total = files.agg(F.sum("length")).first()[0] or 0
    if total > TEXTS_BYTES:
        raise ValueError(f"the licence texts have {total} bytes, more than {TEXTS_BYTES}")
    return {f.path.rsplit("/", 1)[-1].removesuffix(".txt"): (bytes(f.content).decode("utf-8", "replace"),) for f in files.orderBy("path").collect()}


def scan(
    docs: DataFrame,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    least: float = DICE,
    full_texts: Mapping[str, Sequence[str]] = FULL_TEXTS,
) -> DataFrame:
    """(doc_id, license, dice, n_matches) per row of ``docs`` (doc_id, text); license and dice are null if nothing matches."""
    own = Templates(templates, least)
    longer = Templates({n: (*templates.get(n, ()), *full_texts.get(n, ())) for n in {**templates, **full_texts}}, least)

    def both(text: str) -> tuple[str | None, float | None, int]:
        license, likeness, stretches = longer.windows(text)  # a part that matches is or holds such a window
        return license, likeness, own.scan(text)[2] or stretches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [both(t or "") for t in batch.column(1).to_pylist()]
            names, scores, counts = zip(*found, strict=True) if found else ((), (), ())
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(counts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "license", "dice", "n_matches"])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, SCANNED)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document."""
    folder = spark.conf.get(TEXTS_CONF, None)
    more = read_texts(spark, folder) if folder else {}
    texts = {n: (*FULL_TEXTS.get(n, ()), *more.get(n, ())) for n in {**FULL_TEXTS, **more}}
    return scan(inputs.table(spark, sf_dir, "documents"), full_texts=texts)


def _oracle() -> str:
    rows = ", ".join(
        f"({i}, '{name}', '{t.replace(chr(39), chr(39) * 2)}')"
        for i, (name, t) in enumerate((name, t) for name, texts in TEMPLATES.items() for t in texts)
    )
    words = lambda c: f"regexp_extract_all(replace(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'licence', 'license'), '[a-z0-9]+')"
    pair = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t AS (SELECT id, name, {pair} AS p FROM (SELECT id, name, {words("txt")} AS w FROM (VALUES {rows}) AS v(id, name, txt)))
, d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)
, parts AS (SELECT DISTINCT r, part FROM (SELECT r, unnest(string_split(text, chr(10))) AS part FROM d
    UNION ALL SELECT r, unnest(string_split(text, chr(10) || chr(10))) FROM d UNION ALL SELECT r, text FROM d))
, own AS (SELECT row_number() OVER () AS u, r, {pair} AS p FROM (SELECT r, {words("part")} AS w FROM parts) WHERE len(w) > 1)
, shared AS (SELECT u, id, count(*) AS n FROM (SELECT u, unnest(p) AS b FROM own) JOIN (SELECT id, unnest(p) AS b FROM t) USING (b) GROUP BY u, id)
, hits AS (SELECT own.r, own.u, t.name, CAST(2 * n AS DOUBLE) / (len(own.p) + len(t.p)) AS dice FROM shared JOIN own USING (u) JOIN t USING (id))
, good AS (SELECT r, min(struct_pack(d := -dice, name := name)) AS best, CAST(count(DISTINCT u) AS INTEGER) AS n FROM hits WHERE dice >= {DICE}::DOUBLE GROUP BY r)
SELECT doc_id, best.name AS license, -best.d AS dice, coalesce(n, 0)::INTEGER AS n_matches FROM d LEFT JOIN good USING (r)
"""


OP3_SQL = _oracle()
