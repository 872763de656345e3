"""Near-duplicate join: MinHash LSH forest over word shingles, verified exactly.

1. Every text becomes its set of five-word shingles. Texts with equal sets are one class
   of copies, represented by a number of its own, as a doc_id may stand for several sets;
   only representatives go on, each with the text of one row (its id and the text's hash).
   A set so small that no other set can reach the threshold with it is left out.
2. Each of ``TREES`` trees of the forest orders the signatures as paths of ``DEPTH`` levels,
   a byte of a minimum hash per level, packed into one long. All paths are sorted once, over
   ranges of (tree, path, representative), so that a prefix with very many texts is spread
   over ranges too. Sorted, they are prefix tries: the bytes that neighbours have in common
   are the depth of the node where they part. A text is tied to the first text of its node
   (never to each other in pairs) and ranges are tied at their ends.
3. Prefixes are shortened from ``DEPTH`` until, at the threshold, ``RECALL`` of the pairs
   share one in some tree (at 0.8: 6 levels), and from there text by text: a verified link
   whose prefixes all end at the last level shows that the level before had missed it, so
   the text's recall is measured by the share of its links that a longer prefix had found.
   Texts below ``MEASURED`` shorten their prefixes by a level, down to ``SHORTEST``, and the
   components that this joins are verified anew.
4. The connected components of the ties hold every pair that shares a prefix. Within a
   component all pairs are verified by the exact Jaccard likeness of their sets (64-bit
   shingle hashes), in blocks of about ``BLOCK`` against ``BLOCK`` sets. Linked sets' sizes
   differ by at most the factor 1 / threshold, so blocks are cut by size classes of that
   factor and only equal and neighbouring classes are compared. A block pair is a task's
   group, so a component of any size is split, and no pair of it is left out; only counts
   and ties to a block's least id leave the task, not the pairs.
5. Classes are the components of the verified links, named by their least doc_id.

Edge cases: null and empty texts, and texts without words, have no shingles; they are
linked to nothing, not even to each other. Texts of one to four words have one shingle.
Rows that repeat an id count as one document if their sets are equal, else each row is
judged by its own set. Rows with a null id are returned unlinked, with a null class.
An empty table gives no rows; of the input only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import inputs, wordgrams
from ledgerloom.llm.components import components
from ledgerloom.plans.scratch import written

JACCARD = 0.8
TREES = 40
DEPTH = 8
RECALL, MEASURED = 0.99999, 0.999
SHORTEST = 5
BLOCK = 400
BLOCK_SHINGLES = 200_000
SEED = 9
SIGNATURE = "doc_id long, text_hash long, set_hi long, set_lo long, n_shingles int, paths array<long>"
TEXT_HASH = "xxhash64(text) AS text_hash"
TIE = "u long, v long, tree int, path long, depth int, edge int, last boolean"
VERIFIED = "rep long, hub long, links long, shallow long"


def prefix_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold is matched in some tree with the wanted recall."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Each text's distinct shingles in order."""
    out = []
    for a, b in wordgrams.slices(texts):
        shingle, begins = wordgrams.shingles(*wordgrams.words(texts[a:b]), k)
        out += [np.unique(shingle[x:y]) for x, y in zip(begins[:-1], begins[1:], strict=True)]
    return out


def signatures(docs: DataFrame, k: int = wordgrams.SHINGLE_WORDS, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(doc_id, text_hash, set_hi, set_lo, n_shingles, paths) per row of ``docs`` (doc_id, text): 128 bits that name the set, and its tree paths."""
    functions = wordgrams.hash_functions(trees * depth, SEED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in wordgrams.slices(texts):
                sets = _sets(texts[a:b], k)
                sizes = np.array([len(s) for s in sets])
                some = np.flatnonzero(sizes)
                paths = np.zeros((len(sets), trees), np.uint64)
                name = np.zeros((2, len(sets)), np.uint64)
                if len(some):
                    flat = np.concatenate(sets)
                    begins = (np.cumsum(sizes) - sizes)[some]
                    levels = wordgrams.min_hashes(flat, begins, functions).reshape(trees, depth, len(some))
                    levels = (levels * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint64)
                    for level in range(depth):
                        paths[some] = paths[some] << np.uint64(8) | levels[:, level].T
                    name[0][some] = np.add.reduceat(flat, begins)
                    name[1][some] = np.add.reduceat(wordgrams.mix64(flat ^ np.uint64(0x5BF03635)), begins)
                lists = pa.ListArray.from_arrays(
                    np.arange(len(sets) + 1, dtype=np.int32) * trees, paths.ravel().view(np.int64)
                )
                columns = [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), *(pa.array(x.view(np.int64)) for x in name)]
                columns += [pa.array(sizes, pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "set_hi", "set_lo", "n_shingles", "paths"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.expr(TEXT_HASH)).mapInArrow(run, SIGNATURE)


def _depth(tree: np.ndarray, path: np.ndarray, shortest: int) -> np.ndarray:
    """How many bytes each path shares with the one before it in its tree; less than ``shortest`` counts as 0, the first's is 0."""
    out = np.zeros(len(path), np.int32)
    differ = (path[1:] ^ path[:-1]).view(np.uint64)
    for d in range(shortest, DEPTH + 1):
        out[1:][differ < np.uint64(1 << 8 * (DEPTH - d))] = d
    out[1:][tree[1:] != tree[:-1]] = 0
    return out


def trie_ties(representatives: DataFrame, base: int, shortest: int) -> DataFrame:
    """(u, v, tree, path, depth): per text and tree its tie to the node it lies under.

    Up to the ``base`` depth u is tied to the first text of its node of that depth in the
    range, and deeper nodes are within it; where neighbours part at a depth from
    ``shortest`` to below ``base`` they are tied to each other. Ranges are tied at their ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge, before, head = TaskContext.get().partitionId(), None, None
        names = [c.split()[0] for c in TIE.split(", ")]

        def ends(row: tuple, last: bool) -> pa.RecordBatch:
            rep, tree, path = row
            return pa.RecordBatch.from_pylist(
                [{"u": rep, "v": None, "tree": tree, "path": path, "depth": None, "edge": edge, "last": last}], schema=schema
            )

        schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("tree", pa.int32()), ("path", pa.int64()), ("depth", pa.int32()), ("edge", pa.int32()), ("last", pa.bool_())])
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, path, rep = (batch.column(i).to_numpy() for i in range(3))
            if before is None:
                yield ends((int(rep[0]), int(tree[0]), int(path[0])), False)
                before, head = (rep[:1], tree[:1], path[:1]), rep[0]
            rep, tree, path = (np.concatenate(x) for x in zip(before, (rep, tree, path), strict=True))
            depth = _depth(tree, path, shortest)
            at = np.arange(len(rep))
            opens = depth < base
            opens[0] = False
            first = np.maximum.accumulate(np.where(opens, at, 0))
            heads = np.where(first == 0, head, rep[first])
            use = depth > 0
            v = np.where(opens, np.concatenate((rep[:1], rep[:-1])), heads)
            use &= v != rep
            n = int(use.sum())
            if n:
                columns = [pa.array(rep[use]), pa.array(v[use]), pa.array(tree[use], pa.int32()), pa.array(path[use]), pa.array(np.minimum(depth[use], base), pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_())], names=names)
            before, head = (rep[-1:], tree[-1:], path[-1:]), heads[-1]
        if before is not None:
            yield ends((int(before[0][0]), int(before[1][0]), int(before[2][0])), True)

    paths = representatives.select("rep", F.posexplode("paths").alias("tree", "path")).select("tree", "path", "rep")
    ordered = paths.repartitionByRange("tree", "path", "rep").sortWithinPartitions("tree", "path", "rep")
    found = written(ordered.mapInArrow(run, TIE), "ties")
    # two rows for each range: the end of one and the begin of the next
    order = Window.orderBy("edge", "last")
    ends = found.where("edge IS NOT NULL").select("*", *(F.lag(c).over(order).alias(f"p_{c}") for c in ("u", "tree", "path")))
    differ = F.col("path").bitwiseXOR(F.col("p_path"))
    depth = sum((F.when(F.shiftrightunsigned(differ, 8 * (DEPTH - d)) == 0, 1).otherwise(0) for d in range(1, DEPTH + 1)), F.lit(0))
    joined = ends.where("NOT last AND tree = p_tree").select("u", F.col("p_u").alias("v"), "tree", "path", F.least(depth, F.lit(base)).alias("depth"))
    return found.where("edge IS NULL").select("u", "v", "tree", "path", "depth").unionByName(joined.where(F.col("depth") >= shortest))


def contracted(ties: DataFrame) -> DataFrame:
    """Ties (u, v) with the same components and fewer rows: each text is tied to the least of the nodes' first texts that it knows, and these to that one.

    A text has a tie per tree and one more at most where a range ends, so its list is short.
    """
    known = ties.groupBy("u").agg(F.collect_set("v").alias("known"))
    least = known.select("u", F.least("u", F.array_min("known")).alias("v"), "known")
    return least.select(F.explode(F.array_union(F.array("u"), "known")).alias("u"), "v").where("u <> v").distinct()


def _node(tree: str, path: str, depth: int) -> Column:
    return F.xxhash64(tree, F.shiftrightunsigned(path, 8 * (DEPTH - depth)))


def _links(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each set on the left the sets on the right whose Jaccard likeness reaches the threshold."""
    sizes = np.array([len(s) for s in right])
    flat, owner = np.concatenate(right), np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for i, own in enumerate(left):
        first, last = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        counts = last - first
        if not counts.any():
            continue
        at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        shared = np.bincount(owner[at], minlength=len(right))
        yield i, np.flatnonzero(shared >= threshold * (len(own) + sizes - shared) - 1e-9)


def _verify(part: pd.DataFrame, threshold: float, depth: int) -> pd.DataFrame:
    """A block pair: per text its links across the pair, those that prefixes longer than ``depth`` miss, and the least id it is linked with here."""
    part = part.sort_values("rep", ignore_index=True)
    rep, copies, side = part["rep"].to_numpy(), part["copies"].to_numpy(), part["block"].to_numpy()
    one, other = part["i"].iloc[0], part["j"].iloc[0]
    sets = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
    prefixes = np.array(part["paths"].tolist(), np.int64).reshape(len(part), -1) >> np.int64(max(8 * (DEPTH - depth - 1), 0))
    a, b = np.flatnonzero(side == one), np.flatnonzero(side == other)
    links, shallow, parent = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), np.arange(len(part))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if len(a) and len(b):
        for x, found in _links([sets[x] for x in a], [sets[y] for y in b], threshold):
            x, found = a[x], b[found]
            found = found[found != x]
            missed = ~(prefixes[found] == prefixes[x]).any(1) if depth < DEPTH else np.zeros(len(found), bool)
            links[x] += copies[found].sum()
            shallow[x] += copies[found[missed]].sum()
            if one != other:
                links[found] += copies[x]
                shallow[found[missed]] += copies[x]
            for y in found:
                p, q = root(x), root(y)
                parent[max(p, q)] = min(p, q)
    hub = rep[[root(x) for x in range(len(part))]]
    return pd.DataFrame({"rep": rep, "hub": hub, "links": links, "shallow": shallow})[(links > 0) | (hub != rep)]


def _shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """(rep, shingles): the set of each representative, its hashes in order as bytes; ``texts`` is (rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in wordgrams.slices(texts):
                sets = [s.tobytes() for s in _sets(texts[a:b], k)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return texts.select("rep", "text").mapInArrow(run, "rep long, shingles binary")


def _blocks(known: DataFrame, threshold: float) -> DataFrame:
    """(component, rep, block, others): the block of each member of ``known`` (component, node, n_shingles) and all blocks to compare it with."""
    # sizes of linked sets differ by less than this factor, so their classes by one at most
    factor = math.log(1 / threshold * (1 + 1e-6))
    members = known.select("component", F.col("node").alias("rep"), "n_shingles", F.floor(F.log("n_shingles") / factor).cast("int").alias("size"))
    count = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy("component", "size").agg(count.alias("blocks"))
    # a component has at most some tens of size classes
    maps = sizes.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("size", "blocks"))).alias("blocks"))
    label = lambda size, number: size.cast("long") * (1 << 32) + number
    own = F.coalesce(F.element_at("blocks", F.col("size")), F.lit(1))
    numbers = lambda size: F.transform(
        F.sequence(F.lit(0), F.coalesce(F.try_element_at("blocks", size), F.lit(0))), lambda n: F.when(n < F.coalesce(F.try_element_at("blocks", size), F.lit(0)), label(size, n))
    )
    others = F.filter(F.concat(*(numbers(F.col("size") + i) for i in (-1, 0, 1))), lambda x: x.isNotNull())
    return members.join(maps, "component").select(
        "component", "rep", label(F.col("size"), F.pmod(F.xxhash64("rep"), own)).alias("block"), others.alias("others")
    )


def _verified(known: DataFrame, docs: DataFrame, threshold: float, k: int, depth: int) -> DataFrame:
    """``VERIFIED`` rows of the components in ``known`` (component, node, doc_id, text_hash, copies, n_shingles, paths)."""
    wanted = known.select(F.col("node").alias("rep"), "doc_id", "text_hash", "copies", "paths")
    texts = wanted.select("rep", "doc_id", "text_hash").join(docs.select("doc_id", "text", F.expr(TEXT_HASH)), ["doc_id", "text_hash"])
    sets = _shingle_sets(texts, k).groupBy("rep").agg(F.first("shingles").alias("shingles"))  # rows may repeat
    members = _blocks(known, threshold).join(wanted.select("rep", "copies", "paths"), "rep").join(sets, "rep")
    pairs = members.withColumn("other", F.explode("others")).select(
        "component", "rep", "copies", "block", "shingles", "paths", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    return written(pairs.groupBy("component", "i", "j").applyInPandas(lambda part: _verify(part, threshold, depth), VERIFIED), "verified")


def near_duplicates(docs: DataFrame, threshold: float = JACCARD, k: int = wordgrams.SHINGLE_WORDS) -> DataFrame:
    """(doc_id, class_id, n_links) per row of ``docs`` (doc_id, text).

    ``class_id`` is the least id that links lead to; ``n_links`` counts the other rows
    whose likeness reaches the threshold, copies included.
    """
    return _judged(docs, threshold, k).drop("text_hash")


def representatives(signed: DataFrame, threshold: float) -> DataFrame:
    """A row per distinct set of ``signatures`` rows: its number, one of its rows, and how many rows it stands for."""
    return (
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("set_hi", "set_lo")
        .agg(
            F.min(F.struct("doc_id", "text_hash")).alias("least"), F.count("*").alias("copies"),
            F.first("n_shingles").alias("n_shingles"), F.first("paths").alias("paths"),
        )
        .select(F.monotonically_increasing_id().alias("rep"), "least.*", "set_hi", "set_lo", "copies", "n_shingles", "paths")
    )


def forest_links(reps: DataFrame, docs: DataFrame, threshold: float = JACCARD, k: int = wordgrams.SHINGLE_WORDS) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """``VERIFIED`` rows of all linked representatives, and per step (depth, links, links that longer prefixes miss), each link counted from both sides."""
    depth = prefix_depth(threshold)
    shortest = min(depth, SHORTEST)
    # the likest other set has one shingle more
    searched = reps.where(F.col("n_shingles") >= threshold * (F.col("n_shingles") + 1) - 1e-9)
    ties = trie_ties(searched, depth, shortest)
    about = reps.select(F.col("rep").alias("node"), "doc_id", "text_hash", "copies", "n_shingles", "paths")
    grouped = components(contracted(ties.where(F.col("depth") >= depth)))
    found = _verified(grouped.join(about, "node"), docs, threshold, k, depth)
    steps = []
    while True:
        texts = found.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("shallow").alias("shallow"))
        active = written(texts.where((F.col("shallow") > (1 - MEASURED) * F.col("links")) & F.lit(depth > shortest)).select("rep"), "active")
        total = texts.agg(F.sum("links"), F.sum("shallow")).first()
        steps.append((depth, total[0] or 0, total[1] or 0))
        if not active.limit(1).count():
            return found, steps
        depth -= 1
        nodes = active.join(reps, "rep").select(F.posexplode("paths").alias("tree", "path")).select(_node("tree", "path", depth).alias("at")).distinct()
        low = ties.where(F.col("depth").between(depth, prefix_depth(threshold) - 1)).withColumn("at", _node("tree", "path", depth))
        more = written(low.join(nodes, "at", "left_semi").select("u", "v"), "more")
        joined = _joined(grouped, more)
        known = written(joined.join(about, "node"), "changed")
        again = _verified(known, docs, threshold, k, depth)
        found = written(found.join(known.select(F.col("node").alias("rep")), "rep", "left_anti").select(*again.columns).unionAll(again), "verified")
        grouped = grouped.join(joined.select("node"), "node", "left_anti").unionAll(joined)


def _joined(grouped: DataFrame, more: DataFrame) -> DataFrame:
    """(node, component) of all nodes that the ties ``more`` (u, v) bring into another component or into one at all."""
    of = lambda c: grouped.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
    ends = more.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_c", "u").alias("u"), F.coalesce("v_c", "v").alias("v"))
    merged = components(ends.where("u <> v").distinct())
    names = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
    return grouped.join(names, "component").select("node", F.col("into").alias("component")).unionAll(
        merged.join(grouped.select("node"), "node", "left_anti").select("node", "component")
    )


def _judged(docs: DataFrame, threshold: float = JACCARD, k: int = wordgrams.SHINGLE_WORDS) -> DataFrame:
    """``near_duplicates`` with the text's hash, which tells the texts of a repeated id apart."""
    docs = docs.select("doc_id", "text")
    signed = written(signatures(docs, k), "signatures")
    key = ["set_hi", "set_lo"]
    reps = written(representatives(signed, threshold), "representatives")
    verified, _ = forest_links(reps, docs, threshold, k)
    classes = components(verified.select(F.col("rep").alias("u"), F.col("hub").alias("v")))
    named = classes.withColumnRenamed("node", "rep").join(reps.select("rep", "doc_id"), "rep")
    named = named.join(named.groupBy("component").agg(F.min("doc_id").alias("class_id")), "component").select("rep", "class_id")
    counts = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = (
        reps.select("rep", "doc_id", "copies", *key)
        .join(counts, "rep", "left")
        .join(named, "rep", "left")
        .where("copies > 1 or links > 0")
        .select(
            *key,
            F.coalesce("class_id", "doc_id").alias("class_id"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    alone = F.coalesce("n_links", F.lit(0)).cast("long")
    return (
        signed.select("doc_id", "text_hash", *key, F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), 1).alias("known"))
        .join(linked.withColumn("known", F.lit(1)), [*key, "known"], "left")
        .select("doc_id", "text_hash", F.coalesce("class_id", "doc_id").alias("class_id"), alone.alias("n_links"))
    )


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near duplicates and the number of its links."""
    return near_duplicates(inputs.table(spark, sf_dir, "documents"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class, the one that names it; rows with a null id stay."""
    others = _judged(docs).where("doc_id <> class_id").select(F.col("doc_id").alias("other_id"), F.col("text_hash").alias("other_hash")).distinct()
    named = docs.where("doc_id IS NOT NULL")
    kept = named.join(others, (F.col("doc_id") == F.col("other_id")) & (F.xxhash64("text") == F.col("other_hash")), "left_anti")
    if named.groupBy("doc_id").count().where("count > 1").limit(1).count():  # of the ids alone
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionAll(docs.where("doc_id IS NULL"))  # row groups without such rows are not read


OP9_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING count(*) >= 0.8 * (na.n + nb.n - count(*))),
reach AS (SELECT u, v FROM links UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u)
SELECT d.doc_id, least(d.doc_id, coalesce(r.m, d.doc_id)) AS class_id, coalesce(l.n, 0) AS n_links
FROM d LEFT JOIN (SELECT u, min(v) AS m FROM reach GROUP BY u) AS r ON r.u = d.doc_id
LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) AS l ON l.u = d.doc_id
"""
