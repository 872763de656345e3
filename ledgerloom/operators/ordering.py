"""Row numbers, neighbours and nearest times along long orders, without one task per key.

A key (a capture, a computer) may hold a third of all rows, so a window over the key alone
would be one task's work. Rows are cut by their order value into buckets; windows run per
(key, bucket), and one row per bucket carries counts and border values across a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 100_000


def numbered(df: DataFrame, keys: Sequence[str], order: str, name: str, size: int = ROWS) -> DataFrame:
    """Adds the row's number within its keys by a whole-number column, from 1; rows with equal order are numbered in any order."""
    cut = df.withColumn("_bucket", F.floor(F.col(order) / size))
    counts = cut.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(order))
    joined = joined_with_nulls(cut.withColumn("_place", own), offsets, [*keys, "_bucket"])
    return joined.withColumn(name, (F.col("_place") + F.coalesce("_offset", F.lit(0))).cast("long")).drop("_bucket", "_place", "_offset")


def following(df: DataFrame, keys: Sequence[str], order: str, name: str, size: int = ROWS) -> DataFrame:
    """Adds the next row's order value within the keys; null for the last."""
    cut = df.withColumn("_bucket", F.floor(F.col(order) / size))
    firsts = cut.groupBy(*keys, "_bucket").agg(F.min(order).alias("_first"))
    nexts = firsts.select(*keys, "_bucket", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_next"))
    own = F.lead(order).over(Window.partitionBy(*keys, "_bucket").orderBy(order))
    joined = joined_with_nulls(cut.withColumn("_own", own), nexts, [*keys, "_bucket"])
    return joined.withColumn(name, F.coalesce("_own", "_next")).drop("_bucket", "_own", "_next")


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], at: tuple[str, str], value: Column, tie: str, size: int) -> DataFrame:
    """``left`` with ``before`` and ``after``: the right side's nearest rows up to and from its own time, with equal keys.

    ``at`` names the times of both sides, ``value`` is a struct of the right side's columns;
    of rows at the same time the one with the least ``tie`` counts. No pairs are made: both
    sides are sorted into one order per (key, bucket of ``size`` time units), and each
    bucket knows the last row before it and the first after it. Null keys match nothing.
    """
    some = F.lit(True)
    for k in keys:
        some = some & F.col(k).isNotNull()
    events = right.where(some).select(*keys, F.col(at[1]).alias("_at"), F.col(tie).alias("_tie"), value.alias("_value"))
    cut = lambda df, time: df.withColumn("_bucket", F.floor(F.col(time) / size))
    events = cut(events, "_at")
    own = cut(left, at[0])
    holder = F.struct("_at", "_tie", "_value")
    borders = events.groupBy(*keys, "_bucket").agg(
        F.min_by(holder, F.struct("_at", "_tie")).alias("_first"), F.min_by(holder, F.struct(-F.col("_at"), "_tie")).alias("_last")
    )
    buckets = own.where(some).select(*keys, "_bucket").distinct().join(borders, [*keys, "_bucket"], "full")
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket")
    carried = buckets.select(
        *keys, "_bucket",
        F.last("_last", ignorenulls=True).over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.first("_first", ignorenulls=True).over(by_bucket.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )
    columns = [c for c in left.columns if c not in keys]
    both = own.select(*keys, "_bucket", F.col(at[0]).alias("_at"), F.lit(None).cast("long").alias("_tie"), F.struct(*columns).alias("_row"), F.lit(None).alias("_event")).unionByName(
        events.select(*keys, "_bucket", "_at", F.col("_tie").cast("long"), F.lit(None).alias("_row"), holder.alias("_event"))
    )
    # events come before rows of the same time, and of equal times the least tie comes last, so it is the nearest before the row
    place = Window.partitionBy(*keys, "_bucket").orderBy("_at", F.desc_nulls_last("_tie"))
    back = Window.partitionBy(*keys, "_bucket").orderBy(F.desc("_at"), F.desc_nulls_last("_tie"))
    upto = (Window.unboundedPreceding, Window.currentRow)
    found = both.withColumns(
        {"_down": F.last("_event", ignorenulls=True).over(place.rowsBetween(*upto)), "_up": F.last("_event", ignorenulls=True).over(back.rowsBetween(*upto))}
    ).where("_row IS NOT NULL")
    joined = joined_with_nulls(found, carried, [*keys, "_bucket"])
    return joined.select(
        *keys, *(F.col(f"_row.{c}").alias(c) for c in columns), F.coalesce("_down", "_earlier")["_value"].alias("before"), F.coalesce("_up", "_later")["_value"].alias("after")
    )


def joined_with_nulls(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which null keys are equal too."""
    renamed = side.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in side.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(renamed[f"_k_{k}"])
    return df.join(renamed, same, "left").drop(*(f"_k_{k}" for k in keys))


def before(df: DataFrame, keys: Sequence[str], order: str, column: str, name: str, size: int = ROWS) -> DataFrame:
    """Adds the value of ``column`` in the row before within the keys, in a dense or nearly dense whole-number order; null for the first."""
    cut = df.withColumn("_bucket", F.floor(F.col(order) / size))
    lasts = cut.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(F.col(column).alias("v")), order).alias("_last"))
    carried = lasts.select(*keys, "_bucket", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_earlier"))
    own = F.lag(F.struct(F.col(column).alias("v"))).over(Window.partitionBy(*keys, "_bucket").orderBy(order))
    joined = joined_with_nulls(cut.withColumn("_own", own), carried, [*keys, "_bucket"])
    return joined.withColumn(name, F.coalesce("_own", "_earlier")["v"]).drop("_bucket", "_own", "_earlier")


def numbered_with_before(df: DataFrame, keys: Sequence[str], order: str, name: str, column: str, before_name: str, size: int = ROWS) -> DataFrame:
    """``numbered``, and the value of ``column`` in the row before (null for the first), for one shuffle of the rows.

    Rows with equal order stand in the order of ``column``. The key and bucket are one struct, in
    which nulls are equal, so the rows of a bucket lie where both the window and the join want them.
    """
    cut = df.withColumn("_at", F.struct(*keys, F.floor(F.col(order) / size).alias("_bucket")))
    held = F.struct(F.col(column).alias("v"))
    borders = cut.groupBy("_at").agg(F.count("*").alias("_n"), F.max_by(held, F.struct(order, column)).alias("_last"))
    across = Window.partitionBy(*(F.col("_at")[k] for k in keys)).orderBy(F.col("_at")["_bucket"])
    carried = borders.select(
        "_at", F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"), F.lag("_last").over(across).alias("_earlier")
    )
    own = Window.partitionBy("_at").orderBy(order, column)
    placed = cut.withColumns({"_place": F.row_number().over(own), "_own": F.lag(held).over(own)})
    return placed.join(carried, "_at").withColumns(
        {name: (F.col("_place") + F.col("_offset")).cast("long"), before_name: F.coalesce("_own", "_earlier")["v"]}
    ).drop("_at", "_place", "_own", "_offset", "_earlier")


def segmented(df: DataFrame, keys: Sequence[str], at: str, tie: str, gap: int, opening: Column, size: int) -> DataFrame:
    """Adds ``segment_no``, ``running_count`` and ``opened``: runs of rows within the keys between which more than ``gap`` lies.

    Rows are in order of ``at`` (whole numbers; a null opens a run of its own) and ``tie``.
    ``opened`` is the ``opening`` of the run's first row. Each (key, bucket of ``size``) is
    scanned by itself; one row per bucket has its first and last value, its openings and
    its last opening, from which follows what the next buckets begin with.
    """
    cut = df.withColumns({"_bucket": F.floor(F.col(at) / size), "_opening": opening})
    own = Window.partitionBy(*keys, "_bucket").orderBy(at, tie)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.when(F.row_number().over(own) > 1, F.coalesce(F.col(at) - F.lag(at).over(own) > gap, F.lit(True)))
    placed = cut.withColumns({"_place": F.row_number().over(own), "_opens": F.coalesce(opens, F.lit(False))})
    here = F.when(F.col("_opens"), F.struct("_place", "_opening"))
    placed = placed.withColumns({"_inner": F.sum(F.col("_opens").cast("long")).over(upto), "_latest": F.last(here, ignorenulls=True).over(upto)})
    buckets = placed.groupBy(*keys, "_bucket").agg(
        F.count("*").alias("_n"), F.sum(F.col("_opens").cast("long")).alias("_openings"), F.min(at).alias("_first"), F.max(at).alias("_last"),
        F.min_by("_opening", "_place").alias("_head"), F.max_by(F.struct("_place", "_opening"), F.when(F.col("_opens"), F.col("_place"))).alias("_tail"),
    )
    across = Window.partitionBy(*keys).orderBy("_bucket")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_new", F.coalesce(F.col("_first") - F.lag("_last").over(across) > gap, F.lit(True)))
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    last = F.coalesce("_tail", F.when(F.col("_new"), F.struct(F.lit(1).alias("_place"), F.col("_head").alias("_opening"))))
    placed_last = F.when(last.isNotNull(), F.struct((F.col("_before") + last["_place"]).alias("_row"), last["_opening"].alias("_opening")))
    carried = buckets.select(
        *keys, "_bucket", "_new", "_head", "_before",
        F.coalesce(F.sum(F.col("_openings") + F.col("_new").cast("long")).over(earlier), F.lit(0)).alias("_no"),
        F.last(placed_last, ignorenulls=True).over(earlier).alias("_carried"),
    )
    joined = joined_with_nulls(placed, carried, [*keys, "_bucket"])
    place = F.col("_place").cast("long")
    count = (
        F.when(F.col("_latest").isNotNull(), place - F.col("_latest._place") + 1).when(F.col("_new"), place)
        .otherwise(F.col("_before") + place - F.col("_carried._row") + 1)
    )
    return joined.withColumns(
        {
            "segment_no": F.col("_no") + F.col("_new").cast("long") + F.col("_inner"), "running_count": count.cast("long"),
            "opened": F.coalesce("_latest._opening", F.when(F.col("_new"), F.col("_head")), "_carried._opening"),
        }
    ).drop("_bucket", "_opening", "_place", "_opens", "_inner", "_latest", "_new", "_head", "_before", "_no", "_carried")


def nearest_k(left: DataFrame, right: DataFrame, at: tuple[str, str], tie: str, keep: int, reach: int) -> DataFrame:
    """Of every row of ``left`` the ``keep`` rows of ``right`` nearest in time, none farther than ``reach``, with their distance ``delta``.

    Of equal distances the lesser ``tie`` counts. No rows meet by their bucket alone: per bucket of
    ``reach``, with the ``keep`` rows at the neighbours' borders, the right side is numbered,
    and a left row, which knows how many are before it, asks for just the numbers beside it.
    """
    cut = lambda df, time: df.withColumn("_bucket", F.floor(F.col(time) / reach))
    bucket = Window.partitionBy("_bucket")
    events = cut(right.where(F.col(at[1]).isNotNull()).select(F.col(at[1]).alias("_at"), F.col(tie).alias("_tie"), F.struct(*right.columns).alias("_event")), "_at")
    ends = events.withColumns(
        {"_head": F.row_number().over(bucket.orderBy("_at", "_tie")), "_end": F.row_number().over(bucket.orderBy(F.desc("_at"), "_tie"))}
    )
    shared = F.array_compact(F.array("_bucket", F.when(F.col("_head") <= keep, F.col("_bucket") - 1), F.when(F.col("_end") <= keep, F.col("_bucket") + 1)))
    dealt = ends.select(F.explode(shared).alias("_bucket"), "_at", "_tie", "_event")
    rows = cut(left.where(F.col(at[0]).isNotNull()), at[0]).select("_bucket", F.col(at[0]).alias("_at"), F.struct(*left.columns).alias("_row"))
    both = dealt.withColumns({"_row": F.lit(None), "_is": F.lit(1)}).unionByName(rows.withColumns({"_event": F.lit(None), "_tie": F.lit(None), "_is": F.lit(0)}), allowMissingColumns=True)
    # of equal times events come before rows
    count = F.sum("_is").over(bucket.orderBy("_at", F.desc("_is")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    event = F.col("_is") == 1
    placed = both.withColumns(
        {
            "_upto": count,  # at equal times the lesser tie is the nearest, on either side
            "_down": F.when(event, F.sum("_is").over(bucket.orderBy("_at", F.desc("_is"), F.desc("_tie")).rowsBetween(Window.unboundedPreceding, Window.currentRow))),
            "_up": F.when(event, F.sum("_is").over(bucket.orderBy("_at", F.desc("_is"), "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow))),
            "_all": F.sum("_is").over(bucket),
        }
    )
    side = lambda down, number: F.struct(F.lit(down).alias("_below"), number.cast("long").alias("_number"))
    offered = placed.where(event).select("_bucket", "_event", F.explode(F.array(side(True, F.col("_down")), side(False, F.col("_up")))).alias("_s")).select("_bucket", "_event", "_s.*")
    numbers = lambda a, b, down: F.when(a <= b, F.transform(F.sequence(a, b), lambda n: side(down, n))).otherwise(F.array())
    below = numbers(F.greatest(F.lit(1), F.col("_upto") - keep + 1), F.col("_upto"), True)
    above = numbers(F.col("_upto") + 1, F.least(F.col("_all"), F.col("_upto") + keep), False)
    asked = placed.where(~event).select("_bucket", "_at", "_row", F.explode(F.concat(below, above)).alias("_s")).select("_bucket", "_at", "_row", "_s.*")
    met = asked.join(offered, ["_bucket", "_below", "_number"]).withColumn("delta", F.abs(F.col("_at") - F.col("_event")[at[1]])).where(F.col("delta") <= reach)
    return met.select("_row.*", *(F.col(f"_event.{c}").alias(c) for c in right.columns), "delta")
