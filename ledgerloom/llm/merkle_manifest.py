"""A Merkle manifest of a dataset: a tree of digests per group, one above the groups, and a proof for every row.

``H`` is the SHA-256, in lower-case hexadecimal digits, of its inputs joined. A row's leaf is
``H`` of its fields, each ``-`` if null, else its bytes in UTF-8, ``:`` and the value. Per
group the leaves stand in order; every ``fanout`` consecutive ones become their ``H``, the
rest of a run as well, until one is left, the group's subroot. The subroots, in order of
their groups (null first), become the root in the same way.

The work is a pivot per level: nodes are grouped by their parent, conditional aggregates
spread them into one column per slot, all columns joined are hashed to the parent, and
all but the own one are a child's siblings. From the top down each node then gets the
siblings on its path to the root, so rows meet their path once, as many of them as share a
parent in one row. Rows are numbered by one range shuffle of ids and digests (texts are
not moved); one row per range and group carries the counts on, so a group with most of the
rows is many tasks' work. Every level's table is written and a sixteenth of the one below.

Edge cases: a null id stands first in its group and is not tampered with; rows with equal
ids are ordered by their leaves; repeated rows are leaves of their own. A group of one row has
that leaf as subroot, and one group's subroot is the root. An empty table has no rows. Only
the named columns are read, so others may bear any name. A very long text is one row's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import inputs
from ledgerloom.plans.scratch import written

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BROADCAST_ROWS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def spelt(c: Column) -> Column:
    """A field as it enters a leaf; never null, and two values never look alike."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return digest(F.concat(*map(spelt, fields)))


def _together(df: DataFrame, side: DataFrame, rows: int, on: list[str]) -> DataFrame:
    """Join with a table of so many rows; it is broadcast if that is few."""
    return df.join(F.broadcast(side) if rows <= BROADCAST_ROWS else side, on)


def placed(nodes: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``nodes`` with their ``place`` within ``tree``, from 0 in ``order``, and the tree's number of nodes ``n``."""
    by = [F.col("tree"), *order]
    ranged = nodes.repartitionByRange(*by).sortWithinPartitions(*by)
    table = written(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ordered")
    parts = table.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy("tree")
    earlier = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(
        parts.select("tree", "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"), F.sum("_n").over(own).alias("n")), "offsets"
    )
    joined = _together(table, offsets, offsets.count(), ["tree", "_part"])
    return joined.withColumn("place", F.col("_at") - F.col("_first") + F.col("_offset")).drop("_part", "_at", "_first", "_offset")


def fan(nodes: DataFrame, value: Column, fanout: int) -> DataFrame:
    """(tree, n, parent, s0, s1, ...): the children of each parent, spread into a column per slot."""
    slot = F.col("place") % fanout
    spread = [F.max(F.when(slot == i, value)).alias(f"s{i}") for i in range(fanout)]
    return written(nodes.groupBy("tree", "n", F.floor(F.col("place") / fanout).alias("parent")).agg(*spread), "fan")


def _slots(fanout: int, field: str = "") -> list[Column]:
    return [F.col(f"s{i}{field}") for i in range(fanout)]


def _parents(level: DataFrame, hashed: Column, fanout: int) -> DataFrame:
    """The nodes that a level's rows become."""
    return level.select("tree", F.col("parent").alias("place"), F.ceil(F.col("n") / fanout).alias("n"), hashed.alias("hash"))


def _children(level: DataFrame, fanout: int, digests: list[Column], carried: Sequence[str]) -> DataFrame:
    """A row per child with the digests to its left and right, and the parent's ``carried`` columns."""
    each = [
        F.struct(F.lit(i).alias("slot"), s.alias("child"), F.concat_ws("", *digests[:i], F.lit("")).alias("left"), F.concat_ws("", *digests[i + 1 :], F.lit("")).alias("right"))
        for i, s in enumerate(_slots(fanout))
    ]
    rows = level.select("tree", "n", "parent", *carried, F.explode(F.array(*each)).alias("c"))
    return rows.where("c.child IS NOT NULL").select("tree", "n", (F.col("parent") * fanout + F.col("c.slot")).alias("place"), *carried, "c.child", "c.left", "c.right")


class Trees:
    """The levels of many trees, from nodes (tree, place, n, hash) up."""

    def __init__(self, nodes: DataFrame, fanout: int) -> None:
        self.fanout = fanout
        #: By level: rows by parent with their children in slots, and the nodes that are the last of their tree.
        self.fans: list[DataFrame] = []
        self.tops: list[DataFrame] = []
        left = nodes.agg(F.max("n")).first()[0] or 0  # one number
        while left:
            self.tops.append(nodes.where("n = 1").select("tree", "place", "hash"))
            if left > 1:
                level = fan(nodes.where("n > 1"), F.col("hash"), fanout)
                self.fans.append(level)
                nodes = _parents(level, digest(F.concat_ws("", *_slots(fanout))), fanout)
            left = -(-left // fanout) if left > 1 else 0

    def roots(self) -> DataFrame | None:
        """(tree, hash): what remains of each tree; None if there is none."""
        out = None
        for t in self.tops:
            out = t if out is None else out.unionByName(t)
        return out.select("tree", "hash") if out is not None else None

    def paths(self, above: DataFrame, carried: Sequence[str]) -> DataFrame:
        """(tree, place, path, carried): of each node the siblings on the way up, (left, right) per level; ``above`` (tree, path, carried) goes on from a tree's root."""
        out = None
        for k in range(len(self.tops) - 1, -1, -1):
            here = self.tops[k].drop("hash").join(above, "tree")
            if k < len(self.fans):
                met = self.fans[k].join(out.withColumnRenamed("place", "parent"), ["tree", "parent"])
                own = F.concat(F.array(F.struct("left", "right")), F.col("path"))
                below = _children(met, self.fanout, _slots(self.fanout), ["path", *carried])
                here = here.unionByName(below.select("tree", "place", own.alias("path"), *carried))
            out = here
        return out


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Per row of ``leaves`` (doc_id, source, leaf, changed) its proof, and the root that folds from ``changed`` (if it is not null, else from the leaf)."""
    spark = leaves.sparkSession
    table = written(leaves.select("doc_id", spelt(F.col("source")).alias("tree"), "leaf", "changed", F.monotonically_increasing_id().alias("row")), "leaves")
    nodes = placed(table, [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")])
    level = fan(nodes, F.struct("leaf", "doc_id", "changed"), fanout)
    digests = _slots(fanout, ".leaf")
    alone = F.col("n") == 1
    trees = Trees(written(_parents(level, F.when(alone, F.col("s0.leaf")).otherwise(digest(F.concat_ws("", *digests))), fanout), "nodes"), fanout)
    subroots = trees.roots()
    if subroots is None:
        return spark.createDataFrame([], PROOFS)
    # the groups themselves are one tree; its nodes are found again by their names
    name = F.when(F.col("tree") != "-", F.expr("substring(tree, instr(tree, ':') + 1)"))
    groups = subroots.select(F.lit("").alias("tree"), name.alias("source"), F.col("tree").alias("group"), "hash")
    tops = written(placed(groups, [F.col("source").asc_nulls_first()]), "subroots")
    upper = Trees(tops.select("tree", "place", "n", "hash"), fanout)
    nothing = F.array().cast("array<struct<left: string, right: string>>")
    above = upper.paths(upper.roots().select("tree", nothing.alias("path"), F.col("hash").alias("root")), ["root"])
    base = written(tops.select("place", F.col("group").alias("tree"), F.col("hash").alias("subroot")).join(above.drop("tree"), "place").drop("place"), "groups")
    paths = trees.paths(base, ["root", "subroot"])
    met = level.join(paths.withColumnRenamed("place", "parent"), ["tree", "parent"])
    rows = _children(met.withColumn("rest", F.array_join(F.flatten(F.transform("path", lambda p: F.array(p["left"], p["right"]))), "")), fanout, digests, ["path", "rest", "root", "subroot"])
    started = F.coalesce("child.changed", "child.leaf")
    first = F.when(alone, started).otherwise(digest(F.concat("left", started, "right")))
    folded = rows.withColumn("folded_root", F.aggregate("path", first, lambda acc, p: digest(F.concat(p["left"], acc, p["right"]))))
    return folded.select(
        "child.doc_id", "child.leaf", "subroot", "root", digest(F.concat("left", "right", "rest")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def tampered(every: int = 5) -> tuple[Column, Column]:
    """Whether a document is tampered with, and its text then: the letters A-Z in lower case."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % every == 0, F.lit(False)), F.translate("text", _UPPER, _LOWER)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, changed) of ``documents``; ``changed`` is the leaf of a text that was tampered with, else null."""
    fields = [F.col(c) for c in FIELDS]
    hit, text = tampered()
    return docs.select("doc_id", "source", leaf(fields).alias("leaf"), F.when(hit, leaf([*fields[:-1], text])).alias("changed"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof; one in five was tampered with before its proof is folded."""
    return proofs(document_leaves(inputs.table(spark, sf_dir, "documents")))


def _oracle(levels: int = 3) -> str:
    """The same as DuckDB SQL, for at most ``FANOUT ** levels`` documents a source and as many sources."""
    k = FANOUT
    enc = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    head = " || ".join(map(enc, FIELDS[:-1]))

    def tree(name: str, key: str) -> str:
        """Levels over ``name``0 (key, place, n, hash), and per node of it the digests to the left and right on every level, and the root."""
        out = ""
        for i in range(levels):
            out += f"""
, {name}l{i} AS (SELECT {key}, place // {k} AS parent, any_value(n) AS n, list(hash ORDER BY place) AS run FROM {name}{i} GROUP BY {key}, place // {k})
, {name}{i + 1} AS (SELECT {key}, parent AS place, (n + {k - 1}) // {k} AS n, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS hash FROM {name}l{i})"""
        joins = " ".join(f"JOIN {name}l{i} AS r{i} ON r{i}.{key} IS NOT DISTINCT FROM a.{key} AND r{i}.parent = a.place // {k ** (i + 1)}" for i in range(levels))
        at = [f"(a.place // {k**i} % {k})" for i in range(levels)]
        sides = ", ".join(
            f"array_to_string(r{i}.run[1:{at[i]}], '') AS left{i}, array_to_string(r{i}.run[{at[i]} + 2:], '') AS right{i}, r{i}.n = 1 AS alone{i}" for i in range(levels)
        )
        return out + f"\n, {name}p AS (SELECT a.{key}, a.place, {sides}, t.hash AS top FROM {name}0 AS a {joins} JOIN {name}{levels} AS t ON t.{key} IS NOT DISTINCT FROM a.{key})"

    sib = lambda a: " || ".join(f"{a}.left{i} || {a}.right{i}" for i in range(levels))

    def fold(a: str, start: str) -> list[tuple[str, str]]:
        """Names and expressions of the folds, each of the one before."""
        out, before = [], start
        for i in range(levels):
            out.append((f"{a}f{i}", f"CASE WHEN {a}_alone{i} THEN {before} ELSE sha256({a}_left{i} || {before} || {a}_right{i}) END"))
            before = f"{a}f{i}"
        return out

    steps = [*fold("d", "start"), *fold("s", f"df{levels - 1}")]
    chain, frm = "", "met"
    for i, (n, e) in enumerate(steps):
        chain += f"\n, fold{i} AS (SELECT *, {e} AS {n} FROM {frm})"
        frm = f"fold{i}"
    columns = ", ".join(f"{p}.{c}{i} AS {a}_{c}{i}" for a, p in (("d", "dp"), ("s", "sp")) for i in range(levels) for c in ("left", "right", "alone"))
    bits = "(WITH RECURSIVE t(i, b, c) AS (SELECT i, 0, i FROM range(256) AS r(i) UNION ALL SELECT i, b + 1, xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) FROM t WHERE b < 8) SELECT list(c ORDER BY i) FROM t WHERE b = 8)"
    return f"""
WITH crc AS MATERIALIZED (SELECT {bits} AS table_)
, doc AS (SELECT doc_id, source, sha256({head} || {enc('text')}) AS leaf, sha256({head} || {enc(f"translate(text, '{_UPPER}', '{_LOWER}')")}) AS other,
    coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, table_[xor(a, b) % 256 + 1])), 4294967295) % 5 = 0, false) AS hit
    FROM documents, crc)
, d0 AS (SELECT *, leaf AS hash, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM doc){tree('d', 'source')}
, s0 AS (SELECT 1 AS one, source, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM d{levels}){tree('s', 'one')}
, met AS (SELECT d0.doc_id, d0.leaf, dp.top AS subroot, sp.top AS root, sha256({sib('dp')} || {sib('sp')}) AS proof_sha256, CASE WHEN hit THEN other ELSE leaf END AS start, {columns}
    FROM d0 JOIN dp ON dp.source IS NOT DISTINCT FROM d0.source AND dp.place = d0.place JOIN s0 ON s0.source IS NOT DISTINCT FROM d0.source JOIN sp ON sp.place = s0.place){chain}
SELECT doc_id, leaf, subroot, root, proof_sha256, {steps[-1][0]} AS folded_root, {steps[-1][0]} = root AS verified FROM {frm}
"""


OP13_SQL = _oracle()
