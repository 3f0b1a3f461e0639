"""Alarms from scores: one event for each onset of a subject (mission, detector, channel), and the records published about it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.grades import name_of, rank_of, severity
from tidewatch.functions.instants import event_id, seconds

DETECTOR = "r0_limits"


def _column(x: float | str | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def bands(of: dict[str, tuple[float, float]], detector: str = "detector") -> tuple[Column, Column]:
    """(medium, high) of the detector that a column names; a detector without bands stops the job."""
    if wrong := sorted(k for k, (medium, high) in of.items() if not 0 < medium <= high):
        raise ValueError(f"bands must be positive, medium not above high: {wrong}")
    missing = F.raise_error(F.concat(F.lit("no severity bands for detector "), F.coalesce(F.col(detector), F.lit("null")))).cast("double")
    out = []
    for side in (0, 1):
        value = missing
        for name, pair in of.items():
            value = F.when(F.col(detector) == name, F.lit(float(pair[side]))).otherwise(value)
        out.append(value)
    return out[0], out[1]


def admitted(published: DataFrame, hook: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Records as a hook lets them through: it may replace or drop each, not change their columns."""
    out = hook(published)
    if out.columns != published.columns:
        raise ValueError(f"a hook must keep the columns {published.columns}, it gave {out.columns}")
    return out


def alarms(scores: DataFrame, medium: float | Column, high: float | Column, by: tuple[str, ...] = ("mission", "channel"), detector: str | Column = DETECTOR) -> DataFrame:
    """Final state of every event: by..., id, t_start_us, t_end_us, fired_at_us, delay_s, peak, severity, quality, n_firing.

    ``t_end_us`` is the last firing score, or null if no score of the subject follows it: then the event is still open.
    """
    last = F.max("ts_us").over(Window.partitionBy(*by))
    rows = scores.withColumn("last_us", last).where("firing")
    events = rows.groupBy(*by, "onset_us").agg(
        F.min("ts_us").alias("fired_at_us"), F.max("ts_us").alias("last_firing_us"), F.max("score").alias("peak"), F.max(rank_of(F.col("quality"))).alias("worst"), F.count("*").alias("n_firing"), F.max("last_us").alias("last_us")
    )
    return events.select(
        *by,
        event_id(F.col("mission"), _column(detector), F.col("channel"), F.col("onset_us")).alias("id"),
        F.col("onset_us").alias("t_start_us"),
        F.when(F.col("last_us") > F.col("last_firing_us"), F.col("last_firing_us")).alias("t_end_us"),
        "fired_at_us",
        seconds(F.col("fired_at_us") - F.col("onset_us")).alias("delay_s"),
        "peak",
        severity(F.col("peak"), _column(medium), _column(high)).alias("severity"),
        name_of(F.col("worst")).alias("quality"),
        "n_firing",
    )


def records(scores: DataFrame, medium: float | Column, high: float | Column, by: tuple[str, ...] = ("mission", "channel"), detector: str | Column = DETECTOR) -> DataFrame:
    """The upserts about events in the order of ``at_us`` (the score that caused them): opened, rise of severity, close, or finish at the
    end of the stream for those still open (``at_us`` null). Each carries the running peak and worst quality."""
    order = Window.partitionBy(*by).orderBy("ts_us")
    rows = scores.withColumn("next_us", F.lead("ts_us").over(order)).withColumn("next_onset", F.lead("onset_us").over(order)).where("firing")
    upto = Window.partitionBy(*by, "onset_us").orderBy("ts_us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("peak", F.max("score").over(upto)).withColumn("worst", F.max(rank_of(F.col("quality"))).over(upto)).withColumn("fired_at_us", F.min("ts_us").over(upto))
    rows = rows.withColumn("band", severity(F.col("peak"), _column(medium), _column(high)))
    rows = rows.withColumn("before", F.lag("band").over(Window.partitionBy(*by, "onset_us").orderBy("ts_us")))
    before, over = F.col("before"), ~F.col("next_onset").eqNullSafe(F.col("onset_us"))
    made = F.array_compact(
        F.array(
            F.when(before.isNull(), F.struct(F.lit("open").alias("kind"), F.col("ts_us").alias("at_us"), F.lit(None).cast("long").alias("t_end_us"))),
            F.when(before != F.col("band"), F.struct(F.lit("rise").alias("kind"), F.col("ts_us").alias("at_us"), F.lit(None).cast("long").alias("t_end_us"))),
            F.when(F.col("next_us").isNull(), F.struct(F.lit("finish").alias("kind"), F.lit(None).cast("long").alias("at_us"), F.lit(None).cast("long").alias("t_end_us"))),
            F.when(F.col("next_us").isNotNull() & over, F.struct(F.lit("close").alias("kind"), F.col("next_us").alias("at_us"), F.col("ts_us").alias("t_end_us"))),
        )
    )
    rows = rows.withColumn("r", F.explode(made))
    return rows.select(
        *by,
        event_id(F.col("mission"), _column(detector), F.col("channel"), F.col("onset_us")).alias("id"),
        "r.kind",
        "r.at_us",
        F.col("onset_us").alias("t_start_us"),
        "r.t_end_us",
        "fired_at_us",
        "peak",
        F.col("band").alias("severity"),
        name_of(F.col("worst")).alias("quality"),
    )


def final(published: DataFrame, seq: Column) -> DataFrame:
    """The last record of each id is the event."""
    return published.groupBy("id").agg(F.max_by(F.struct(*[c for c in published.columns if c != "id"]), seq).alias("e")).select("id", "e.*")


def as_events(found: DataFrame, detector: str = DETECTOR, created_at_us: Column | None = None) -> DataFrame:
    """Alarms in the published, nested shape."""
    ts = lambda c: F.timestamp_micros(c)
    return found.select(
        "id",
        "mission",
        ts(F.col("t_start_us")).alias("t_start"),
        ts(F.col("t_end_us")).alias("t_end"),
        F.array(F.struct("channel", F.lit(1.0).alias("weight"))).alias("channels"),
        F.array(F.struct(F.lit(detector).alias("detector"), F.lit(None).cast("string").alias("model_version"), F.col("peak").alias("score"), ts(F.col("fired_at_us")).alias("fired_at"), "delay_s")).alias("detections"),
        "severity",
        "quality",
        F.lit(None).cast("string").alias("context"),
        F.lit("open").alias("status"),
        F.lit(None).cast("string").alias("verdict"),
        ts(created_at_us if created_at_us is not None else F.col("fired_at_us")).alias("created_at"),
    )


def first_detection(events: DataFrame) -> DataFrame:
    """Adds ``first_detection``, when the earliest of an event's detections fired."""
    return events.withColumn("first_detection", F.array_min(F.transform("detections", lambda x: x["fired_at"])))


def fired_by(events: DataFrame, detector: str) -> DataFrame:
    """Adds ``fired_at``, when the given detector fired for the event; null if it did not."""
    own = F.filter("detections", lambda x: x["detector"] == detector)
    return events.withColumn("fired_at", F.try_element_at(F.transform(own, lambda x: x["fired_at"]), F.lit(1)))
