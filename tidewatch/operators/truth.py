"""Ground truth: segments of labelled samples, continuous runs, labelled events, observed time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import intervals
from tidewatch.functions.instants import SECOND, nanos


def segments(samples: DataFrame) -> DataFrame:
    """samples(segment, channel, ts_us, sampling_s, anomaly, train) -> one row a segment; ``mixed`` if its rows disagree on the labels."""
    kinds = F.struct("channel", "sampling_s", "anomaly", "train")
    out = samples.groupBy("segment").agg(F.min(kinds).alias("k"), F.max(kinds).alias("k2"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count("*").alias("samples"))
    return out.select("segment", "k.*", "start_us", "end_us", "samples", (F.col("k") != F.col("k2")).alias("mixed"))


def runs(found: DataFrame, periods: float, *by: str) -> DataFrame:
    """Adds ``run``: it grows where the silence before a segment is longer than ``periods`` of the segment's own sampling period."""
    order = Window.partitionBy(*by, "channel").orderBy("start_us", "segment")
    broken = (F.col("start_us") - F.lag("end_us").over(order) > F.lit(float(periods)) * F.col("sampling_s") * SECOND).cast("int")
    rows = found.withColumn("broken", F.coalesce(broken, F.lit(0)))
    return rows.withColumn("run", F.sum("broken").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("broken")


def run_spans(with_runs: DataFrame) -> DataFrame:
    return with_runs.groupBy("channel", "run").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("segments"))


def labelled_events(with_runs: DataFrame) -> DataFrame:
    """Longest stretches of anomalous segments inside a run: id is ``channel:first segment``."""
    order = Window.partitionBy("channel", "run").orderBy("start_us", "segment")
    rows = with_runs.withColumn("stretch", F.sum((~F.col("anomaly")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("anomaly")
    members = F.array_sort(F.collect_list(F.struct("start_us", "segment")))
    out = rows.groupBy("channel", "run", "stretch").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), members.alias("m"))
    ids = F.transform("m", lambda x: x["segment"])
    return out.select(F.concat_ws(":", "channel", F.element_at(ids, 1).cast("string")).alias("id"), "channel", "start_us", "end_us", ids.alias("segments"))


def observed_seconds(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """spans(start_us, end_us), blocks(block, block_start_us, block_end_us) -> seconds of the union of clipped spans in each block.

    Touching spans merge. Blocks are a handful by configuration.
    """
    rows = spans.join(F.broadcast(blocks), (F.col("start_us") < F.col("block_end_us")) & (F.col("end_us") >= F.col("block_start_us")))
    rows = rows.select("block", F.greatest("start_us", "block_start_us").alias("lo"), F.least("end_us", "block_end_us").alias("hi"))
    order = Window.partitionBy("block").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("island", F.sum(F.coalesce((F.col("lo") > reach).cast("int"), F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = rows.groupBy("block", "island").agg((F.max("hi") - F.min("lo")).alias("us"))
    return merged.groupBy("block").agg((F.sum("us") / float(SECOND)).alias("observed_s"))


def straddling(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """Labelled events cut by a block's start or end: start < boundary <= end."""
    edges = blocks.select("block", F.explode(F.array("block_start_us", "block_end_us")).alias("boundary_us"))
    return events.join(F.broadcast(edges), (F.col("start_us") < F.col("boundary_us")) & (F.col("boundary_us") <= F.col("end_us")))


def in_blocks(events: DataFrame, blocks: DataFrame, at: str = "start_us") -> DataFrame:
    return events.join(F.broadcast(blocks), (F.col(at) >= F.col("block_start_us")) & (F.col(at) < F.col("block_end_us")))


def embargo(lookback_s: float, events: DataFrame) -> DataFrame:
    """Longest lookback plus the longest labelled event, over all labels."""
    return events.agg((F.max(F.col("end_us") - F.col("start_us")) / float(SECOND)).alias("longest_event_s")).select((F.col("longest_event_s") + lookback_s).alias("embargo_s"), "longest_event_s")


def flagged_spans(series: DataFrame, start_us: int, end_us: int, *by: str) -> DataFrame:
    """series(by..., ts_us, flagged), a step series -> (by..., a, b) of its flagged stretches on the doubled nanosecond grid.

    The first and last values hold to the ends of the range. A stretch runs to the next point that isn't flagged, open; one that lasts to
    the end of the series is closed.
    """
    ends = series.groupBy(*by).agg(*[f(F.struct("ts_us", "flagged")).alias(n) for n, f in (("first", F.min), ("last", F.max))])
    more = F.array_compact(F.array(F.when(F.col("first.ts_us") > start_us, F.struct(F.lit(start_us).cast("long").alias("ts_us"), F.col("first.flagged").alias("flagged"))), F.when(F.col("last.ts_us") < end_us, F.struct(F.lit(end_us).cast("long").alias("ts_us"), F.col("last.flagged").alias("flagged")))))
    rows = series.select(*by, "ts_us", "flagged").unionByName(ends.select(*by, F.explode(more).alias("x")).select(*by, "x.*"))
    order = Window.partitionBy(*by).orderBy("ts_us")
    rows = rows.withColumn("run", F.sum((~F.col("flagged")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("next_us", F.lead("ts_us").over(order)).where("flagged")
    runs_ = rows.groupBy(*by, "run").agg(F.min("ts_us").alias("lo"), F.max_by(F.struct("ts_us", "next_us"), "ts_us").alias("z"))
    b = F.coalesce(intervals.upper(nanos(F.col("z.next_us")), closed=False), intervals.upper(nanos(F.col("z.ts_us"))))
    return runs_.select(*by, intervals.lower(nanos(F.col("lo"))).alias("a"), b.alias("b"))
