"""What scores and events must satisfy, as rows that don't: an empty result is a sound table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.grades import QUALITIES, SEVERITIES, finite
from tidewatch.operators.detect import fresh

#: What the weights of an event's channels may sum to, rounding allowed for.
MOST_WEIGHT = 1.0 + 1e-6


def _broken(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with ``broken``, the names of the rules they break; a rule that is null is broken."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return rows.withColumn("broken", names).where(F.size("broken") > 0)


def unsound_scores(scores: DataFrame) -> DataFrame:
    """scores(mission, channel, ts_us, score, firing, onset_us, quality, ...)."""
    return _broken(
        scores,
        {
            "named": (F.length("mission") > 0) & (F.length("channel") > 0),
            "score is finite and not negative": finite(F.col("score")) & (F.col("score") >= 0),
            "an onset exactly while firing": F.col("firing") == F.col("onset_us").isNotNull(),
            "the onset is not later": F.col("onset_us").isNull() | (F.col("onset_us") <= F.col("ts_us")),
            "a known quality": F.col("quality").isin(*QUALITIES),
        },
    )


def unsound_events(events: DataFrame) -> DataFrame:
    """Events in the published shape (``arbiter.as_events``)."""
    weights = F.aggregate("channels", F.lit(0.0), lambda total, c: total + c["weight"])
    return _broken(
        events,
        {
            "named": (F.length("id") > 0) & (F.length("mission") > 0),
            "it ends after it starts, or not yet": F.col("t_end").isNull() | (F.col("t_end") >= F.col("t_start")),
            "of some channel": F.size("channels") > 0,
            "found by some detector": F.size("detections") > 0,
            "weights within one": weights <= MOST_WEIGHT,
            "known grades": F.col("severity").isin(*SEVERITIES) & F.col("quality").isin(*QUALITIES),
        },
    )


def backwards(samples: DataFrame, arrival: str, *by: str) -> DataFrame:
    """Samples not later than one that arrived before them: a detector takes none of these (see ``detect.fresh``)."""
    return fresh(samples, arrival, *by).where(~F.col("fresh")).drop("fresh")
