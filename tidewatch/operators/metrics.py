"""How alarms compare with labelled events: event-wise, timing quality, channel-aware, delays, classification of segments, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import intervals
from tidewatch.functions.grades import f_beta, ratio
from tidewatch.functions.instants import SECOND, nanos
from tidewatch.functions.running import by_quantiles

#: Cell of the overlap joins on the doubled nanosecond grid: six hours.
CELL = 2 * 6 * 3600 * 10**9
#: What a point annotation is widened by for the channel-aware scores, in nanoseconds.
POINT_NS = 1_000_000


def detections(alarms: DataFrame, range_end_us: int, *by: str) -> DataFrame:
    """Alarms as intervals on the doubled nanosecond grid: flagged from t_start, cleared a nanosecond after t_end; an open alarm runs to the
    end of the range, closed. (by..., a, b), merged."""
    open_ = F.col("t_end_us").isNull()
    b = F.when(open_, intervals.upper(nanos(F.lit(range_end_us).cast("long")))).otherwise(intervals.upper(nanos(F.col("t_end_us")) + 1, closed=False))
    return intervals.union(alarms.select(*by, intervals.lower(nanos(F.col("t_start_us"))).alias("a"), b.alias("b")), *by)


def annotated(events: DataFrame, widen: bool = False) -> DataFrame:
    """Labelled events as closed intervals: (id, channel, a2, b2)."""
    start, end = nanos(F.col("start_us")), nanos(F.col("end_us"))
    end = F.when(start == end, end + POINT_NS).otherwise(end) if widen else end
    return events.select("id", "channel", intervals.lower(start).alias("a2"), intervals.upper(end).alias("b2"))


def _fragments(truth: DataFrame, *by: str) -> DataFrame:
    merged = intervals.union(truth.select(*by, F.col("a2").alias("a"), F.col("b2").alias("b")), *by)
    return merged.select(*by, F.col("a").alias("a2"), F.col("b").alias("b2"))


def event_wise(events: DataFrame, alarms: DataFrame, start_us: int, end_us: int, beta: float) -> DataFrame:
    """One row: tp, fp, fn, redundant, nominal_ns, false_ns (alarmed nominal time), precision (corrected by the TNR), tnr, recall, f,
    alarming_precision. Channels are OR-ed.

    Events must lie in [start_us, end_us]; there must be nominal time, or the TNR is null and the precision is not corrected.
    """
    truth = annotated(events)
    p = detections(alarms, end_us)
    touch = intervals.overlaps(p, _fragments(truth, "id"), CELL)
    hits = touch.groupBy("id", "a2").agg(F.count("*").alias("hits")).groupBy("id").agg(F.sum(F.col("hits") - 1).alias("redundant"))
    lo, hi = F.lit(2000 * start_us).cast("long"), F.lit(2000 * end_us).cast("long")
    within = lambda df: df.select(F.greatest("a", lo).alias("a"), F.least("b", hi).alias("b")).where("a <= b")
    labelled = within(intervals.union(truth.select(F.col("a2").alias("a"), F.col("b2").alias("b")))).select(F.col("a").alias("a2"), F.col("b").alias("b2"))
    ns, ns2 = intervals.length(F.col("a"), F.col("b")), intervals.length(F.col("a2"), F.col("b2"))
    # Lengths add up: nominal time is the range less what is labelled, and so is the alarmed part of it.
    both = intervals.overlaps(within(p), labelled, CELL).select(F.greatest("a", "a2").alias("a"), F.least("b", "b2").alias("b"))
    # Every part of the result is a sum over rows of one union.
    names = ("tp", "redundant", "ids", "fp", "labelled_ns", "false_ns")
    rows = lambda df, **given: df.select(*[given.get(n, F.lit(0)).cast("long").alias(n) for n in names])
    parts = rows(hits, tp=F.lit(1), redundant=F.col("redundant"))
    parts = parts.unionByName(rows(truth.select("id").distinct(), ids=F.lit(1)))
    parts = parts.unionByName(rows(p.join(touch.select("a").distinct(), "a", "left_anti"), fp=F.lit(1)))
    parts = parts.unionByName(rows(labelled, labelled_ns=ns2)).unionByName(rows(within(p), false_ns=ns)).unionByName(rows(both, false_ns=-ns))
    one = parts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    one = one.withColumn("nominal_ns", F.nullif(intervals.length(lo, hi) - F.col("labelled_ns"), F.lit(0)))
    raw = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    one = one.withColumn("fn", F.col("ids") - F.col("tp")).withColumn("raw", raw).withColumn("tnr", F.when(F.col("raw") > 0, 1 - F.col("false_ns") / F.col("nominal_ns")))
    one = one.withColumn("precision", F.col("raw") * F.coalesce("tnr", F.lit(1.0))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return one.select("tp", "fp", "fn", "redundant", "nominal_ns", "false_ns", "precision", "tnr", "recall", f_beta(F.col("precision"), F.col("recall"), beta).alias("f"), ratio(F.col("tp"), F.col("tp") + F.col("redundant")).alias("alarming_precision"))


def timing_curve(latency: Column, alpha: Column, length: Column, exponent: float) -> Column:
    x = F.lit(float(exponent))
    return (
        F.when(((alpha == 0) | (length == 0)) & (latency == 0), 1.0)
        .when((latency <= -alpha) | (latency >= length), 0.0)
        .when(latency <= 0, F.pow((latency + alpha) / alpha, x))
        .otherwise(1.0 / (1.0 + F.pow(latency / (length - latency), x)))
    )


def timing(events: DataFrame, alarms: DataFrame, end_us: int, exponent: float) -> DataFrame:
    """(id, latency_ns, latency_s, quality) of every event that a detection on one of its own channels touches."""
    truth = annotated(events)
    p = detections(alarms, end_us, "channel")
    parts = _fragments(truth, "id", "channel")
    touch = intervals.overlaps(p, parts, CELL, "channel").groupBy("id").agg(F.min("a").alias("first"))
    whole = truth.groupBy("id").agg(F.min("a2").alias("lo"), F.max("b2").alias("hi"))
    # The previous anomaly is the last distinct start before.
    starts = whole.select("lo").distinct().withColumn("previous", F.lag("lo").over(Window.orderBy("lo")))
    rows = touch.join(whole, "id").join(starts, "lo")
    half = lambda x: F.shiftright(x, 1)
    length, latency = half(F.col("hi") - F.col("lo")), half(F.col("first")) - half(F.col("lo"))
    alpha = F.least(length, half(F.col("lo") - F.coalesce("previous", F.col("lo") - 2 * length)))
    return rows.select("id", latency.alias("latency_ns"), (latency / 1e9).alias("latency_s"), timing_curve(latency, alpha, length, exponent).alias("quality"))


def timing_summary(each: DataFrame) -> DataFrame:
    n = F.count("*")
    return each.agg(F.avg("quality").alias("score"), F.count_if(F.col("latency_s") < 0).alias("before"), F.count_if(F.col("latency_s") >= 0).alias("after"), F.when(n > 0, F.count_if(F.col("latency_s") >= 0) / n).alias("after_rate"))


def channel_aware(events: DataFrame, alarms: DataFrame, channels: DataFrame, end_us: int, beta: float) -> DataFrame:
    """(id, tp, fp, fn, precision, recall, f): is each channel's detection in an event's full span where the event was annotated?

    ``channels``: those under detection; annotations elsewhere don't count. A detection that meets another event's span on its channel
    is no false one.
    """
    truth = annotated(events, widen=True).join(channels.select("channel"), "channel")
    p = detections(alarms, end_us, "channel")
    full = _fragments(truth, "id")
    inside = intervals.overlaps(p, full, CELL).select("id", "channel", F.greatest("a", "a2").alias("a"), F.least("b", "b2").alias("b"))
    hit = inside.select("id", "channel").distinct().withColumn("hit", F.lit(True))
    parts = _fragments(truth, "id", "channel").select(F.col("id").alias("other"), "channel", "a2", "b2")
    met = intervals.overlaps(inside, parts, CELL, "channel").where("other <> id").select("id", "channel").distinct().withColumn("excused", F.lit(True))
    marked = truth.select("id", "channel").distinct().withColumn("affected", F.lit(True))
    rows = marked.join(hit, ["id", "channel"], "full").join(met, ["id", "channel"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = rows.groupBy("id").agg(F.count_if(yes("affected") & yes("hit")).alias("tp"), F.count_if(~yes("affected") & yes("hit") & ~yes("excused")).alias("fp"), F.count_if(yes("affected") & ~yes("hit")).alias("fn"))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f", f_beta(F.col("precision"), F.col("recall"), beta))


def alarm_delays(events: DataFrame, alarms: DataFrame, width_us: int = 6 * 3600 * SECOND) -> DataFrame:
    """(id, delay_s): for each event that an alarm of its channel overlaps (both closed, microseconds), when the earliest such alarm fired."""
    a = events.select("id", "channel", F.col("start_us").alias("a2"), F.col("end_us").alias("b2"))
    # An open alarm ends nowhere: the last event's end is far enough.
    far = F.lit(events.agg(F.max("end_us")).first()[0]).cast("long")
    e = alarms.select("channel", F.col("t_start_us").alias("a"), F.greatest(F.coalesce("t_end_us", far), F.col("t_start_us")).alias("b"), "fired_at_us")
    both = intervals.overlaps(e, a, width_us, "channel")
    return both.groupBy("id").agg(F.min_by("fired_at_us", "a").alias("fired"), F.min("a2").alias("start")).select("id", ((F.col("fired") - F.col("start")) / float(SECOND)).alias("delay_s"))


def distribution(values: DataFrame, column: str, *by: str) -> DataFrame:
    """n, median, nearest-rank 90th percentile, maximum."""
    agg = [F.count(column).alias("n"), F.percentile(column, F.lit(0.5)).alias("median"), F.expr(f"percentile_disc(0.9) within group (order by {column})").alias("p90"), F.max(column).alias("max")]
    return values.groupBy(*by).agg(*agg) if by else values.agg(*agg)


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """rows(label, flagged) booleans -> counts, accuracy, precision, recall, f1, mcc; 0 / 0 is 0."""
    y, f = F.col("label"), F.col("flagged")
    agg = [F.count_if(y & f).alias("tp"), F.count_if(~y & f).alias("fp"), F.count_if(y & ~f).alias("fn"), F.count_if(~y & ~f).alias("tn")]
    c = rows.groupBy(*by).agg(*agg) if by else rows.agg(*agg)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    c = c.withColumn("accuracy", ratio(tp + tn, n)).withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", F.when(tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0))
    # Covariance form, in doubles, as the product of four counts passes 64 bits.
    cov = n * tp - (tp + fp) * (tp + fn)
    flagged, labelled = (tp + fp) * (fn + tn), (tp + fn) * (fp + tn)
    return c.withColumn("mcc", F.when((flagged > 0) & (labelled > 0), cov / F.sqrt(flagged * labelled)).otherwise(0.0))


def curve(rows: DataFrame) -> DataFrame:
    """rows(label, score) -> a point for each distinct score, descending: pos, neg (its own rows), tp, fp, recall, precision, fpr.

    Distinct scores are dealt out by their quantiles; running sums go inside a bucket and over a row a bucket. Rows without a score come last.
    """
    at = rows.groupBy(F.col("score").cast("double").alias("score")).agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    at = by_quantiles(at, "score", "bucket")
    each = at.groupBy("bucket").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    earlier, whole = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    each = each.select("bucket", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in "pn"], *[F.sum(c).over(whole).alias(f"all_{c}") for c in "pn"])
    order = Window.partitionBy("bucket").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = at.join(each, "bucket").withColumn("tp", F.sum("pos").over(order) + F.col("p_before")).withColumn("fp", F.sum("neg").over(order) + F.col("n_before"))
    return out.select("score", "pos", "neg", "tp", "fp", (F.col("tp") / F.nullif("all_p", F.lit(0))).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("fp") / F.nullif("all_n", F.lit(0))).alias("fpr"))


def average_precision(points: DataFrame) -> DataFrame:
    """Each point adds its step in recall, which is its own positives', times its precision."""
    return points.agg(F.sum(F.when(F.col("tp") > 0, F.col("recall") * F.col("pos") / F.col("tp")).otherwise(0.0) * F.col("precision")).alias("average_precision"))


def roc_auc(points: DataFrame) -> DataFrame:
    """Trapezoids between a point and the one before: a point's own rows tell where that lies."""
    width = F.when(F.col("fp") > 0, F.col("fpr") * F.col("neg") / F.col("fp")).otherwise(0.0)
    height = F.when(F.col("tp") > 0, F.col("recall") * (2 * F.col("tp") - F.col("pos")) / F.col("tp")).otherwise(0.0)
    return points.agg(F.sum(width * height / 2).alias("roc_auc"))


def summary(folds: DataFrame, measures: list[str]) -> DataFrame:
    """(fold, measures...) -> n, mean, min, max of each measure, nulls skipped."""
    long = folds.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures])).alias("x")).select("x.*")
    return long.groupBy("measure").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
