"""Publication of an archive as a stream: order, schedule, resume, identity."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.instants import SECOND, channel_rank_key


def channel_ranks(readings: DataFrame, seed: int) -> DataFrame:
    """(channel, rank): order of SHA-256 of seed and name. One row a channel."""
    return readings.select("channel").distinct().withColumn("rank", (F.row_number().over(Window.orderBy(channel_rank_key(seed, F.col("channel")))) - 1).cast("long"))


def window(readings: DataFrame, start_us: int | None, end_us: int | None) -> DataFrame:
    """Half-open time filter; a missing side is open."""
    if start_us is not None and end_us is not None and end_us <= start_us:
        raise ValueError("a window must end after it starts")
    out = readings if start_us is None else readings.where(F.col("ts_us") >= start_us)
    return out if end_us is None else out.where(F.col("ts_us") < end_us)


def published(readings: DataFrame, start_us: int | None, speed: float, wall_us: int, seed: int = 0) -> DataFrame:
    """Adds rank and wall_us, when each reading is due: wall anchor + (mission time - mission anchor) / speed. The anchor in mission time is
    the window's start, so silence before the first reading is kept, or the first reading."""
    if start_us is None:
        start_us = readings.agg(F.min("ts_us")).first()[0] or 0
    due = F.lit(wall_us) + F.floor((F.col("ts_us") - start_us) / F.lit(float(speed)))
    return readings.join(channel_ranks(readings, seed), "channel").withColumn("wall_us", due.cast("long"))


def offline(readings: DataFrame) -> DataFrame:
    """The stream at speed 1 on a clock that jumps: published when measured."""
    return readings.withColumn("wall_us", F.col("ts_us"))


def ordered(stream: DataFrame) -> DataFrame:
    """Total order: (ts_us, rank)."""
    return stream.orderBy("ts_us", "rank")


def after(stream: DataFrame, ts_us: int, rank: int) -> DataFrame:
    """What follows a position. The first condition reaches the scan, the second drops what was published at that instant."""
    return stream.where((F.col("ts_us") >= ts_us) & ((F.col("ts_us") > ts_us) | (F.col("rank") > rank)))


def placed(stream: DataFrame, published: int = 0, stretch_us: int = 3600 * SECOND) -> DataFrame:
    """Adds place (in the total order, after ``published`` earlier ones) and next_wall_us, when the following sample is due.

    Rows are ranked inside stretches of time; what a stretch needs of the others is a row each: how many come before, what comes next.
    """
    rows = stream.withColumn("stretch", F.floor(F.col("ts_us") / stretch_us))
    inside = Window.partitionBy("stretch").orderBy("ts_us", "rank")
    each = rows.groupBy("stretch").agg(F.count("*").alias("n"), F.min_by("wall_us", F.struct("ts_us", "rank")).alias("first_us"))
    over = Window.orderBy("stretch")
    earlier = F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.select("stretch", (earlier + published).alias("before"), F.lead("first_us").over(over).alias("after_us"))
    rows = rows.withColumn("own", F.row_number().over(inside)).withColumn("lead_us", F.lead("wall_us").over(inside)).join(each, "stretch")
    return rows.withColumn("place", (F.col("before") + F.col("own")).cast("long")).withColumn("next_wall_us", F.coalesce("lead_us", "after_us")).drop("stretch", "own", "lead_us", "before", "after_us")


def checkpoints(stream: DataFrame, every: int, idle_us: int) -> DataFrame:
    """Of a stream with places: the samples after which a position is saved, each ``every``-th and those before a wait longer than
    ``idle_us``. Not the last: a stream that is complete keeps no position."""
    waits = (F.col("next_wall_us") - F.col("wall_us")) > idle_us
    return stream.where(F.col("next_wall_us").isNotNull() & ((F.col("place") % every == 0) | waits))


def fingerprint(describe: dict, start_us: int | None, end_us: int | None, seed: int) -> str:
    """Identity of a stream: data, window and seed; not its speed."""
    whole = {"source": describe, "start_us": start_us, "end_us": end_us, "seed": seed}
    return hashlib.sha256(json.dumps(whole, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
