"""Limit, rate and state checks with persistence, hysteresis and gap reset, as windows over one exchange by channel.

All windows partition by supersets of ``by``, so one hash exchange serves them; the sequential state machine becomes islands:

* ``seg``: a silence strictly longer than max_gap_s starts afresh;
* a run of violations is what stands between two rows that don't violate; it persists from its n-th row or T-th second on;
* ``epoch``: a row that is back inside by the margin ends an alarm; within an epoch the first run to persist holds the latch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.grades import finite, name_of, rank_of
from tidewatch.functions.instants import SECOND, seconds

BY = ("mission", "channel")


def refused(samples: DataFrame, limits: DataFrame, mission: str | None = None) -> DataFrame:
    """Rows that the limits don't apply to, with the reason: another mission, no entry, or a kind that doesn't fit the check."""
    known = limits.select("channel", "check")
    rows = samples.join(known, "channel", "left")
    numeric = F.col("kind").isin("numeric", "counter")
    reason = F.when(F.col("mission") != mission, "mission") if mission is not None else F.lit(None).cast("string")
    reason = F.coalesce(reason, F.when(F.col("check").isNull(), "no entry").when((F.col("check") == "limits") & ~numeric, "numeric limits do not apply").when((F.col("check") == "states") & (F.col("kind") != "categorical"), "allowed states do not apply"))
    return rows.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("mission", "channel", "kind", "reason").distinct()


def fresh(samples: DataFrame, arrival: str, *by: str) -> DataFrame:
    """Samples that move their channel forward in order of arrival; repeats and late ones are dropped, the first arrival wins."""
    before = Window.partitionBy(*by).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("ts_us").over(before)
    return samples.withColumn("fresh", F.coalesce(F.col("ts_us") > top, F.lit(True)))


def segmented(samples: DataFrame, gap_us: Column, *by: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``seg``, the number of silences longer than the gap so far. Samples of one instant go in the order of ``ties``."""
    order = Window.partitionBy(*by).orderBy("ts_us", *ties)
    silent = (F.col("ts_us") - F.lag("ts_us").over(order) > gap_us).cast("int")
    return samples.withColumn("silent", F.coalesce(silent, F.lit(0))).withColumn("seg", F.sum("silent").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("silent")


def rated(samples: DataFrame, *by: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``rate``, the change a second against the previous sample of the segment, ``elapsed_us`` since that sample, and its quality.

    Between samples of one instant the rate is what floating point makes of a division by 0: infinite, or NaN if nothing changed.
    Which of them comes first is open unless ``ties`` orders them.
    """
    order = Window.partitionBy(*by, "seg").orderBy("ts_us", *ties)
    rows = samples.withColumn("elapsed_us", F.col("ts_us") - F.lag("ts_us").over(order))
    change = F.abs(F.col("value") - F.lag("value").over(order))
    rate = F.when(F.col("elapsed_us") == 0, change * float("inf")).otherwise(change / seconds(F.col("elapsed_us")))
    return rows.withColumn("rate", rate).withColumn("previous_quality", F.lag("quality").over(order))


def scored(samples: DataFrame, limits: DataFrame, by: tuple[str, ...] = BY, on: tuple[str, ...] = ("channel",)) -> DataFrame:
    """samples(by..., ts_us, value, quality), limits(on..., check, ...) -> one row for each sample that gets a score.

    Columns: by..., ts_us, value (the sample's), score >= 0, violating, firing, onset_us, run_start_us, run_n, quality. No opinion
    is no row: channels without check, and values that are not finite (these don't touch the state). Limits join by ``on``, and
    a limits table with more keys than the samples (policies, folds) multiplies the samples: its keys then belong to ``by``.
    A rate limit says nothing between samples of one instant.
    """
    rows = samples.where(finite(F.col("value"))).join(limits.where("`check` <> 'none'").drop("reason"), list(on))
    rows = rated(segmented(rows, F.col("max_gap_s") * SECOND, *by), *by)
    span = F.col("high") - F.col("low")
    margin = F.col("hysteresis") * span
    over = F.greatest(F.col("low") - F.col("value"), F.col("value") - F.col("high"), F.lit(0.0)) / span
    limited = F.col("max_rate").isNotNull() & F.coalesce(F.col("elapsed_us") > 0, F.lit(False))
    too_fast = F.when(limited, F.greatest(F.col("rate") - F.col("max_rate"), F.lit(0.0)) / F.col("max_rate"))
    inside = (F.col("low") + margin <= F.col("value")) & (F.col("value") <= F.col("high") - margin)
    inside = inside & (~limited | (F.col("rate") <= F.col("max_rate") * (1 - F.col("hysteresis"))))
    state = F.col("check") == "states"
    strange = ~F.array_contains("allowed", F.col("value"))
    worst = F.when(limited & ~state, name_of(F.greatest(rank_of(F.col("quality")), rank_of(F.col("previous_quality"))))).otherwise(F.col("quality"))
    rows = rows.withColumn("score", F.when(state, strange.cast("double")).otherwise(F.greatest(over, too_fast)))
    rows = rows.withColumn("violating", F.col("score") > 0).withColumn("clear", ~F.col("violating") & F.when(state, ~strange).otherwise(inside)).withColumn("quality", worst)
    upto = Window.partitionBy(*by, "seg").orderBy("ts_us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("island", F.sum((~F.col("violating")).cast("int")).over(upto)).withColumn("epoch", F.sum(F.col("clear").cast("int")).over(upto))
    run = Window.partitionBy(*by, "seg", "island").orderBy("ts_us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("run_start_us", F.when(F.col("violating"), F.min(F.when(F.col("violating"), F.col("ts_us"))).over(run)))
    rows = rows.withColumn("run_n", F.when(F.col("violating"), F.sum(F.col("violating").cast("int")).over(run)).otherwise(0).cast("long"))
    lasted = F.coalesce(F.col("run_n") >= F.col("persist_n"), seconds(F.col("ts_us") - F.col("run_start_us")) >= F.col("persist_s"))
    latch = Window.partitionBy(*by, "seg", "epoch").orderBy("ts_us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onset = F.first(F.when(F.col("violating") & lasted, F.col("run_start_us")), ignorenulls=True).over(latch)
    return rows.withColumn("onset_us", onset).select(*by, "ts_us", "value", "score", "violating", F.col("onset_us").isNotNull().alias("firing"), "onset_us", "run_start_us", "run_n", "quality")


def coverage(samples: DataFrame, scores: DataFrame, *by: str) -> DataFrame:
    """samples(by..., fresh), scores -> counts a channel and (with by null) in all: samples, repeats, scored, firing, ratio."""
    a = samples.groupBy(*by).agg(F.count("*").alias("samples"), F.count_if(~F.col("fresh")).alias("repeats"))
    b = scores.groupBy(*by).agg(F.count("*").alias("scored"), F.count_if("firing").alias("firing"))
    each = a.join(b, list(by), "left").fillna(0, ["scored", "firing"])
    names = ("samples", "repeats", "scored", "firing")
    out = each.rollup(*by[-1:]).agg(*[F.sum(n).cast("long").alias(n) for n in names])
    return out.withColumn("ratio", F.when(F.col("samples") > F.col("repeats"), F.col("scored") / (F.col("samples") - F.col("repeats"))).otherwise(0.0))
