"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.scratch import written


#: A node's neighbours are dealt out to so many tasks.
SALTS = 16


def _star(edges: DataFrame, least: DataFrame, keep: str) -> DataFrame:
    """Each edge's far end with the least node that its near end knows."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    every = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    every = every.hint("merge")  # Spark would judge its size before the salts multiply it, and might broadcast it
    return salted.join(every, ["u", "salt"]).where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _stars(edges: DataFrame) -> bool:
    """Whether no node of the distinct edges (u > v) has two edges down, or one down and one up."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    degrees = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not degrees.where("down > 1 or down + up > 1").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u long, v long); a component is its least node.

    Alternates the large-star and small-star steps: each node hands its neighbours the
    least node it knows. A step is one aggregation with map-side minima and one join,
    salted because a node may have very many neighbours; each round is written, so that
    no lineage grows. The number of rounds grows with the logarithm of a component's size.
    It ends when the edges are stars: every node has one edge down, or only edges up. Loops and
    repeated edges do no harm; nodes without an edge to another are not returned.
    """
    edges = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    while not _stars(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _star(both, least, "v > u").distinct()  # larger neighbours point to the least
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _star(large, lower, "v <> m").unionAll(lower.select("u", F.col("m").alias("v")))
        edges = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
