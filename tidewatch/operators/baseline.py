"""Beyond limits: rolling baseline scores and continuous aggregates of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.grades import finite


def rolling(samples: DataFrame, k: int, *by: str) -> DataFrame:
    """Adds n, mean, sd and z of each finite sample against the ``k`` before it on its channel; z is null while fewer than two are known or
    they don't vary. The sample itself and the future have no part in its score."""
    before = Window.partitionBy(*by).orderBy("ts_us").rowsBetween(-k, -1)
    rows = samples.where(finite(F.col("value"))).withColumn("n", F.count("*").over(before)).withColumn("mean", F.avg("value").over(before)).withColumn("sd", F.stddev_samp("value").over(before))
    return rows.withColumn("z", F.when(F.col("sd") > 0, F.abs(F.col("value") - F.col("mean")) / F.col("sd")))


def rollup(samples: DataFrame, width_us: int, *by: str) -> DataFrame:
    """(by..., start_us, n, low, high, mean): aggregates of half-open stretches of ``width_us``. One partial and one final sum a group."""
    start = (F.floor(F.col("ts_us") / width_us) * width_us).alias("start_us")
    return samples.where(finite(F.col("value"))).groupBy(*by, start).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))


def coarser(finer: DataFrame, width_us: int, *by: str) -> DataFrame:
    """A rollup of rollups: hours from minutes, days from hours, without the readings."""
    start = (F.floor(F.col("start_us") / width_us) * width_us).alias("start_us")
    return finer.groupBy(*by, start).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"))
