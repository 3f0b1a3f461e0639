"""JSON-lines samples in and records out, with nulls written and unknown keys refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.instants import of_iso

SAMPLE_SCHEMA = "mission string, channel string, mission_ts string, wall_ts string, value double, kind string, unit string, quality string"
SAMPLE_KEYS = tuple(x.split()[0] for x in SAMPLE_SCHEMA.split(", "))


def partition_key() -> Column:
    """What keeps a channel's samples in order on a bus of partitions."""
    return F.concat_ws("/", "mission", "channel")


def to_lines(df: DataFrame) -> DataFrame:
    """One JSON object a row; null fields are written."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value"))


def write_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    to_lines(df).write.mode(mode).text(path)


def parsed(lines: DataFrame, *more: str) -> DataFrame:
    """(value, more...) -> samples and ``more``; blank lines are skipped, and a malformed line or an unknown key stops the job."""
    text = lines.where(F.length(F.trim("value")) > 0)
    row = F.from_json("value", SAMPLE_SCHEMA, {"mode": "FAILFAST"})
    keys = F.json_object_keys("value")
    unknown = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in SAMPLE_KEYS]))) > 0
    checked = F.when(unknown | keys.isNull(), F.raise_error(F.concat(F.lit("unusable sample: "), F.col("value")))).otherwise(row)
    s = text.select(checked.alias("s"), *more).select("s.*", *more)
    return s.select(*more, "mission", "channel", of_iso(F.col("mission_ts")).alias("ts_us"), of_iso(F.col("wall_ts")).alias("wall_us"), "value", "kind", "unit", "quality")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines below a folder, with ``arrival``: their order by file and place in it."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    arrival = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    return parsed(lines.select("value", arrival.alias("arrival")), "arrival")


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The same, as a stream over a folder: one file a trigger, oldest first."""
    return parsed(spark.readStream.option("maxFilesPerTrigger", 1).text(folder))


def as_samples(df: DataFrame) -> DataFrame:
    """Readings or a stream with ts_us and wall_us in the published shape."""
    iso = lambda c: F.date_format(F.timestamp_micros(F.col(c)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return df.select("mission", "channel", iso("ts_us").alias("mission_ts"), iso("wall_us").alias("wall_ts"), "value", "kind", F.col("unit").cast("string").alias("unit"), "quality")


