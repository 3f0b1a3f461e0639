"""Limits of channels: derived from nominal training data, or read from a file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMITS_SCHEMA = "channel string, `check` string, low double, high double, max_rate double, allowed array<double>, hysteresis double, persist_n int, persist_s double, max_gap_s double, reason string"


@dataclass(frozen=True)
class Policy:
    """When an alarm starts and ends. Exactly one of ``samples`` and ``seconds`` is set."""

    hysteresis: float
    max_gap_s: float
    samples: int | None = None
    seconds: float | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.hysteresis < 0.5:
            raise ValueError("hysteresis must be in [0, 0.5): at one half no value would be inside")
        if (self.samples is None) == (self.seconds is None):
            raise ValueError("persistence is either a number of samples or a number of seconds")
        if self.samples is not None and self.samples < 1 or self.seconds is not None and self.seconds <= 0 or self.max_gap_s <= 0:
            raise ValueError("persistence and max_gap_s must be positive")

    def lookback_s(self, rate_limited: bool = False) -> float:
        """How far back the decision to fire can reach."""
        span = (self.samples - 1) * self.max_gap_s if self.samples is not None else self.seconds + self.max_gap_s
        return span + (self.max_gap_s if rate_limited else 0.0)

    def columns(self) -> dict:
        return {
            "hysteresis": F.lit(float(self.hysteresis)),
            "persist_n": F.lit(self.samples).cast("int"),
            "persist_s": F.lit(self.seconds).cast("double"),
            "max_gap_s": F.lit(float(self.max_gap_s)),
        }


def nominal(samples: DataFrame) -> DataFrame:
    """Samples labelled nominal: ``anomaly`` false."""
    return samples.where(~F.col("anomaly"))


def envelope(nominal_values: DataFrame, margin: float, *by: str) -> DataFrame:
    """(by..., value) -> (by..., low, high): the range, pushed out on each side by ``margin`` times its width. Constant groups have none."""
    seen = nominal_values.groupBy(*by).agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("hi > lo")
    pad = F.lit(float(margin)) * (F.col("hi") - F.col("lo"))
    return seen.select(*by, (F.col("lo") - pad).alias("low"), (F.col("hi") + pad).alias("high"))


def derived(channels: DataFrame, nominal_values: DataFrame, margin: float, policy: Policy, *by: str) -> DataFrame:
    """channels(by..., kind), nominal_values(by..., value) -> limits, one row a channel.

    By kind, in this order: a telecommand is not checked; neither is a channel without nominal data; a categorical one allows the
    codes seen; a constant one is not checked; any other gets its envelope.
    """
    stats = nominal_values.groupBy(*by).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    codes = nominal_values.join(channels.where("kind = 'categorical'").select(*by), list(by)).groupBy(*by).agg(F.array_sort(F.collect_set("value")).alias("codes"))
    rows = channels.join(stats, list(by), "left").join(codes, list(by), "left")
    rule = (
        F.when(F.col("kind") == "telecommand", "telecommand").when(F.col("n").isNull(), "empty").when(F.col("kind") == "categorical", "states").when(F.col("hi") <= F.col("lo"), "constant").otherwise("limits")
    )
    rows = rows.withColumn("rule", rule)
    pad = F.lit(float(margin)) * (F.col("hi") - F.col("lo"))
    bounded = F.col("rule") == "limits"
    reason = F.when(F.col("rule") == "telecommand", "telecommand").when(F.col("rule") == "empty", "untrained").when(F.col("rule") == "constant", "constant")
    return rows.select(
        *by,
        F.when(F.col("rule").isin("limits", "states"), F.col("rule")).otherwise("none").alias("check"),
        F.when(bounded, F.col("lo") - pad).alias("low"),
        F.when(bounded, F.col("hi") + pad).alias("high"),
        F.lit(None).cast("double").alias("max_rate"),
        F.when(F.col("rule") == "states", F.col("codes")).alias("allowed"),
        *[c.alias(n) for n, c in policy.columns().items()],
        reason.alias("reason"),
    )


def nominal_counts(channels: DataFrame, nominal_values: DataFrame, *by: str) -> DataFrame:
    """Number of nominal samples of every declared channel, 0 included."""
    return channels.select(*by).join(nominal_values.groupBy(*by).count(), list(by), "left").select(*by, F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def cannot_fire(samples: DataFrame, limits: DataFrame, *by: str) -> DataFrame:
    """Whether no policy could make a channel's check fire on these values: they stay inside, and no rate is limited."""
    checked = limits.select(*by, "check", "low", "high", "max_rate", "allowed")
    strange = F.coalesce((F.col("check") == "states") & ~F.array_contains("allowed", F.col("value")), F.lit(False))
    seen = samples.join(checked.select(*by, "check", "allowed"), list(by)).groupBy(*by).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.max(strange).alias("strange"))
    rows = seen.join(checked, list(by))
    inside = F.col("max_rate").isNull() & (F.col("low") <= F.col("lo")) & (F.col("hi") <= F.col("high"))
    known = ~F.col("strange")
    return rows.select(*by, F.when(F.col("check") == "limits", inside).when(F.col("check") == "states", known).otherwise(F.lit(True)).alias("cannot_fire"))


def lookback(limits: DataFrame, *by: str) -> DataFrame:
    """limits(by..., ...) -> (by..., lookback_s): the longest of the checked channels, 0 where none is checked."""
    gap = F.col("max_gap_s")
    reach = F.coalesce((F.col("persist_n") - 1) * gap, F.col("persist_s") + gap) + F.when((F.col("check") == "limits") & F.col("max_rate").isNotNull(), gap).otherwise(0.0)
    longest = F.coalesce(F.max(F.when(F.col("check") != "none", reach)), F.lit(0.0)).alias("lookback_s")
    return limits.groupBy(*by).agg(longest) if by else limits.agg(longest)
