"""Labelled telemetry archives in CSV: channel, timestamp, value, label, sampling, anomaly, segment, train.

Checks run before a plan is handed out: bad rows are counted and shown by one job, so no result is ever made from a file that is refused.
Label columns have their own reader; readings never carry them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.grades import KINDS, finite
from tidewatch.functions.instants import of_iso

READING_COLUMNS = ("channel", "timestamp", "value")
LABEL_COLUMNS = ("channel", "timestamp", "value", "sampling", "anomaly", "segment", "train")


class IngestError(ValueError):
    """The archive is not what the configuration says it is."""


@dataclass(frozen=True)
class Channel:
    kind: str
    unit: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise IngestError(f"unknown kind {self.kind!r}")


@dataclass(frozen=True)
class Archive:
    """A CSV archive and the channels it is declared to hold."""

    path: str
    mission: str
    channels: dict[str, Channel] = field(default_factory=dict)

    def digest(self, spark: SparkSession) -> str:
        """MD5 of the file's bytes."""
        try:
            rows = spark.read.format("binaryFile").load(self.path).select(F.md5("content").alias("md5")).collect()
        except Exception as error:
            raise IngestError(f"{self.path} not found or unreadable") from error
        if len(rows) != 1:
            raise IngestError(f"{self.path} is {len(rows)} files, not one")
        return rows[0]["md5"]

    def describe(self, spark: SparkSession) -> dict:
        """Identity of the data, whatever its path."""
        specs = {n: {"kind": c.kind, "unit": c.unit} for n, c in sorted(self.channels.items())}
        return {"adapter": "csv", "md5": self.digest(spark), "mission": self.mission, "channels": specs}

    def _raw(self, spark: SparkSession, columns: tuple[str, ...]) -> DataFrame:
        raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(self.path)
        if missing := [c for c in columns if c not in raw.columns]:
            raise IngestError(f"{self.path} lacks the columns {', '.join(missing)}")
        return raw.select(*columns)

    def _specs(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, c.kind, c.unit) for n, c in sorted(self.channels.items())], "channel string, kind string, unit string")

    def readings(self, spark: SparkSession) -> DataFrame:
        """(mission, channel, ts_us, value, kind, unit, quality), checked."""
        raw = self._raw(spark, READING_COLUMNS)
        rows = raw.select("channel", of_iso(F.col("timestamp")).alias("ts_us"), F.expr("try_cast(value as double)").alias("value"), F.struct(*READING_COLUMNS).alias("row"))
        _refuse(rows.where(F.col("channel").isNull() | F.col("ts_us").isNull() | ~finite(F.col("value"))), "row", "a channel, an instant with a zone and a finite value are required")
        _refuse(rows.groupBy("channel", "ts_us").count().where("count > 1").select(F.struct("channel", "ts_us").alias("row")), "row", "two rows for one channel and instant")
        found = rows.select("channel").distinct()
        declared = self._specs(spark)
        extra = sorted(r[0] for r in found.join(declared, "channel", "left_anti").collect())
        lacking = sorted(r[0] for r in declared.join(found, "channel", "left_anti").collect())
        if extra or lacking:
            raise IngestError(f"{self.path}: undeclared channels {extra}, declared but absent {lacking}")
        return rows.join(declared, "channel").select(F.lit(self.mission).alias("mission"), "channel", "ts_us", "value", "kind", "unit", F.lit("ok").alias("quality"))

    def labelled(self, spark: SparkSession) -> DataFrame:
        """(segment, channel, ts_us, value, sampling_s, anomaly, train), checked."""
        raw = self._raw(spark, LABEL_COLUMNS)
        digits = lambda c: F.when(F.col(c).rlike("^[0-9]+$"), F.expr(f"try_cast({c} as int)"))
        flag = lambda c: F.when(F.col(c) == "1", True).when(F.col(c) == "0", False)
        rows = raw.select(
            digits("segment").alias("segment"), "channel", of_iso(F.col("timestamp")).alias("ts_us"), F.expr("try_cast(value as double)").alias("value"), digits("sampling").alias("sampling_s"), flag("anomaly").alias("anomaly"), flag("train").alias("train"), F.struct(*LABEL_COLUMNS).alias("row")
        )
        bad = F.col("segment").isNull() | F.col("channel").isNull() | F.col("ts_us").isNull() | ~finite(F.col("value")) | ~F.coalesce(F.col("sampling_s") > 0, F.lit(False)) | F.col("anomaly").isNull() | F.col("train").isNull()
        _refuse(rows.where(bad), "row", "labels must be 0 or 1, segments digits, sampling positive")
        return rows.drop("row")


def _refuse(rows: DataFrame, column: str | Column, why: str) -> None:
    if found := rows.select(F.to_json(column)).limit(3).collect():
        raise IngestError(f"{why}: {'; '.join(r[0] for r in found)}")
