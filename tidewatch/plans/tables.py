"""The driver's tables seen as telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.instants import micros
from tidewatch.operators.limits import Policy, envelope

#: 2024-01-15, -22 and -31 in microseconds: training before the first, two test blocks.
TEST_US, MIDDLE_US, END_US = (1705276800000000, 1705881600000000, 1706659200000000)
NOMINAL_MAX, MARGIN, PERIODS = 60.0, 0.1, 2.0
MEDIUM, HIGH, BETA, EXPONENT = 0.1, 0.5, 0.5, 2.0
POLICIES = {"g7200n2": Policy(0.05, 7200.0, samples=2), "g3600n3": Policy(0.05, 3600.0, samples=3), "g7200t1800": Policy(0.1, 7200.0, seconds=1800.0)}
MAIN = "g7200n2"
BUCKET_US = 6 * 3600 * 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str, *kept: str) -> DataFrame:
    """events as readings: a channel for each event_type; columns of events named in ``kept`` stay beside."""
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("events").alias("mission"), F.col("event_type").alias("channel"), micros(F.col("ts")).alias("ts_us"), "value", F.lit("numeric").alias("kind"), F.lit(None).cast("string").alias("unit"), F.lit("ok").alias("quality"), *kept)


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as categorical readings: the code in props."""
    e = table(spark, sf_dir, "events")
    code = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.lit("events").alias("mission"), F.col("event_type").alias("channel"), micros(F.col("ts")).alias("ts_us"), code.alias("value"), F.lit("categorical").alias("kind"), F.lit("ok").alias("quality"))


def training(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("ts_us") < TEST_US)


def tested(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("ts_us") >= TEST_US)


def bounds(samples: DataFrame) -> DataFrame:
    return envelope(training(samples).where(F.col("value") <= NOMINAL_MAX), MARGIN, "channel")


def limits(samples: DataFrame, *policies: str) -> DataFrame:
    """Derived limits under each named policy; with several, a column ``policy``."""
    own = bounds(samples)
    parts = [
        own.select(F.lit(p).alias("policy"), "channel", F.lit("limits").alias("check"), "low", "high", F.lit(None).cast("double").alias("max_rate"), F.lit(None).cast("array<double>").alias("allowed"), *[c.alias(n) for n, c in POLICIES[p].columns().items()], F.lit(None).cast("string").alias("reason"))
        for p in policies or (MAIN,)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled samples: a segment for each channel and six hours, anomalous if its largest value is over 150."""
    r = readings(spark, sf_dir).select("channel", "ts_us", "value").withColumn("bucket", F.floor(F.col("ts_us") / BUCKET_US))
    place = F.expr("array_position(array('click', 'error', 'purchase', 'signup', 'view'), channel)")
    seg = r.groupBy("channel", "bucket").agg((F.max("value") > 150).alias("anomaly"))
    rows = r.join(seg, ["channel", "bucket"]).withColumn("segment", F.col("bucket") * 8 + place)
    return rows.select("segment", "channel", "ts_us", "value", F.lit(3600).alias("sampling_s"), "anomaly", (F.col("segment") % 4 != 0).alias("train"))


def blocks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, TEST_US, MIDDLE_US), (2, MIDDLE_US, END_US)], "block int, block_start_us long, block_end_us long")
