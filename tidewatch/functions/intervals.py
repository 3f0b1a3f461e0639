"""Interval algebra on a doubled grid: every interval is a closed integer interval [a, b].

A closed lower end L is 2L, an open one 2L + 1; a closed upper end U is 2U, an open one 2U - 1. Then an interval is empty if a > b, two
intersect in [greatest(a), least(b)] and merge if a2 <= b1 + 1, whatever their ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.running import carried

#: Stretch of the grid that a task merges where spans have no key: six hours of doubled nanoseconds.
STRETCH = 2 * 6 * 3600 * 10**9


def lower(at: Column, closed: bool = True) -> Column:
    return at * 2 + (0 if closed else 1)


def upper(at: Column, closed: bool = True) -> Column:
    return at * 2 - (0 if closed else 1)


def length(a: Column, b: Column) -> Column:
    """Length in grid units of the interval; ends don't matter. Shifts, as halves of nanoseconds since 1970 are beyond a double."""
    return F.shiftright(b + 1, 1) - F.shiftright(a, 1)


def union(spans: DataFrame, *by: str, stretch: int = STRETCH) -> DataFrame:
    """spans(by..., a, b) -> maximal intervals of each group's union; empty ones vanish.

    One exchange on ``by``. Without it spans are cut at stretches of the grid and merged inside each; then only what reaches an edge of its
    stretch, at most two intervals each, goes to one task to be joined.
    """
    rows = spans.where("a <= b").select(*by, "a", "b")
    if by:
        return _merged(rows, *by)
    first = lambda c: F.expr(f"{c} div {stretch}L - if({c} < 0 and {c} % {stretch}L <> 0, 1, 0)")
    rows = rows.withColumn("lo", F.explode(F.transform(F.sequence(first("a"), first("b")), lambda k: k * stretch)))
    rows = rows.select("lo", F.greatest("a", "lo").alias("a"), F.least(F.col("b"), F.col("lo") + (stretch - 1)).alias("b"))
    merged = _merged(rows, "lo")
    edge = (F.col("a") == F.col("lo")) | (F.col("b") == F.col("lo") + (stretch - 1))
    return merged.where(~edge).select("a", "b").unionByName(_merged(merged.where(edge).select("a", "b")))


def _merged(rows: DataFrame, *by: str) -> DataFrame:
    within = Window.partitionBy(*by).orderBy("a", "b")
    reach = F.max("b").over(within.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce((F.col("a") > reach + 1).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("new").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*by, "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")


def overlaps(left: DataFrame, right: DataFrame, width: int, *on: str) -> DataFrame:
    """Pairs of intervals left(..., a, b) and right(..., a2, b2) that share a point, equal in ``on``.

    An equi-join on cells of ``width`` grid units, so no nested loop: each interval is laid into the cells it touches, and a pair counts in the
    first cell that both touch. ``width`` should be about a usual interval's length.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    l, r = left.where("a <= b").withColumn("cell", cells("a", "b")), right.where("a2 <= b2").withColumn("cell", cells("a2", "b2"))
    out = l.join(r, [*on, "cell"]).where("a <= b2 and a2 <= b")
    return out.where(F.col("cell") == F.floor(F.greatest("a", "a2") / width)).drop("cell")


def intersection(left: DataFrame, right: DataFrame, width: int, *by: str) -> DataFrame:
    """left(by..., a, b) and right(by..., a, b) as sets -> the union's maximal intervals of what both hold."""
    pairs = overlaps(left.select(*by, "a", "b"), right.select(*by, F.col("a").alias("a2"), F.col("b").alias("b2")), width, *by)
    return union(pairs.select(*by, F.greatest("a", "a2").alias("a"), F.least("b", "b2").alias("b")), *by)


def complement(holes: DataFrame, lo: int, hi: int, stretch: int = STRETCH) -> DataFrame:
    """The interval [lo, hi] of the grid minus all holes(a, b): the pieces before each of the holes' islands, and the one after the last."""
    merged = union(holes.select("a", "b"), stretch=stretch).withColumn("stretch", F.floor(F.col("a") / stretch))
    merged = carried(merged, "stretch", reach=(F.max("b"), F.max))
    # Islands are disjoint, so the end before is the greatest end so far.
    before = F.coalesce(F.lag("b").over(Window.partitionBy("stretch").orderBy("a")), "reach")
    low, high = F.lit(lo).cast("long"), F.lit(hi).cast("long")
    pieces = merged.select(F.greatest(low, F.coalesce(before + 1, low)).alias("a"), F.least(high, F.col("a") - 1).alias("b"))
    tail = merged.agg(F.max("b").alias("last")).select(F.greatest(low, F.coalesce(F.col("last") + 1, low)).alias("a"), high.alias("b"))
    return pieces.unionByName(tail).where("a <= b")


def difference(outer: DataFrame, holes: DataFrame, width: int, *by: str) -> DataFrame:
    """outer(by..., a, b) minus holes(by..., a, b) as sets, within each group: the maximal intervals left. Any number of intervals a group."""
    merged = union(holes.select(*by, "a", "b"), *by)
    kept = union(outer.select(*by, "a", "b"), *by)
    frame = kept.groupBy(*by).agg(F.min("a").alias("lo"), F.max("b").alias("hi"))
    inside = frame.join(merged, list(by), "left")
    before = F.lag("b").over(Window.partitionBy(*by).orderBy("a"))
    gaps = inside.select(*by, F.greatest("lo", F.coalesce(before + 1, "lo")).alias("a"), F.coalesce(F.least("hi", F.col("a") - 1), "hi").alias("b"))
    tail = inside.groupBy(*by).agg(F.max("lo").alias("lo"), F.max("hi").alias("b"), F.max("b").alias("last")).select(*by, F.greatest("lo", F.col("last") + 1).alias("a"), "b").where(F.col("last").isNotNull())
    return intersection(kept, gaps.unionByName(tail).where("a <= b"), width, *by)
