"""Invariants, bands by detector, the admission hook, step series, lookbacks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import arbiter, checks, limits, truth
from tidewatch.operators.limits import LIMITS_SCHEMA

SCORE = "mission string, channel string, ts_us long, score double, firing boolean, onset_us long, quality string"


def test_unsound_scores(spark):
    good = [("m", "c", 5, 0.0, False, None, "ok"), ("m", "c", 5, 2.0, True, 5, "suspect")]
    bad = [("", "c", 5, 0.0, False, None, "ok"), ("m", "c", 5, -1.0, False, None, "ok"), ("m", "c", 5, float("inf"), False, None, "ok"), ("m", "c", 5, 1.0, True, None, "ok"), ("m", "c", 5, 1.0, False, 4, "ok"), ("m", "c", 5, 1.0, True, 6, "ok"), ("m", "c", 5, 1.0, True, 5, "fine"), ("m", "c", 5, None, None, None, None)]
    out = checks.unsound_scores(spark.createDataFrame(good + bad, SCORE)).collect()
    assert len(out) == len(bad) and sorted(len(r.broken) for r in out) == [1] * 7 + [3]


def test_unsound_events(spark):
    rows = [("m", "c", t, 1.0, f, 3 if f else None, "ok") for t, f in ((1, False), (4, True), (6, True), (9, False))]
    events = arbiter.as_events(arbiter.alarms(spark.createDataFrame(rows, SCORE), 0.1, 0.5))
    assert events.count() == 1 and checks.unsound_events(events).count() == 0
    half = F.struct(F.lit("d").alias("channel"), F.lit(0.5).alias("weight"))
    for change in ({"t_end": F.timestamp_micros(F.lit(0))}, {"channels": F.array_append("channels", half)}, {"channels": F.slice("channels", 1, 0)}, {"detections": F.slice("detections", 1, 0)}, {"severity": F.lit("dire")}, {"id": F.lit("")}):
        assert len(checks.unsound_events(events.withColumns(change)).first().broken) == 1


def test_backwards(spark):
    df = spark.createDataFrame([(k, "c", t) for k, t in enumerate((5, 7, 7, 6, 8))], "arrival int, channel string, ts_us long")
    assert sorted(r.arrival for r in checks.backwards(df, "arrival", "channel").collect()) == [2, 3]


def test_bands_and_hook(spark):
    rows = spark.createDataFrame([("m", "c", 4, 0.3, True, 4, "ok")], SCORE)
    both = rows.withColumn("detector", F.explode(F.array(F.lit("x"), F.lit("y"))))
    by = ("detector", "mission", "channel")
    medium, high = arbiter.bands({"x": (0.1, 0.2), "y": (0.2, 0.9)})
    found = {r.detector: (r.id, r.severity) for r in arbiter.alarms(both, medium, high, by, F.col("detector")).collect()}
    assert {k: v[1] for k, v in found.items()} == {"x": "high", "y": "medium"} and all(v[0].startswith(f"m:{k}:c:") for k, v in found.items())
    with pytest.raises(Exception, match="no severity bands for detector y"):
        arbiter.alarms(both, *arbiter.bands({"x": (0.1, 0.2)}), by, F.col("detector")).collect()
    with pytest.raises(ValueError):
        arbiter.bands({"x": (0.0, 0.2)})
    published = arbiter.records(rows, 0.1, 0.5)
    assert arbiter.admitted(published, lambda r: r.where("kind = 'open'")).count() == 1
    with pytest.raises(ValueError):
        arbiter.admitted(published, lambda r: r.drop("peak"))


def test_flagged_spans_of_a_step_series(spark):
    r = random.Random(8)
    rows = [(g, t, r.random() < 0.5) for g in range(20) for t in sorted(r.sample(range(5, 25), r.randint(1, 8)))]
    df = spark.createDataFrame(rows, "g int, ts_us long, flagged boolean")
    got = {(x.g, x.a, x.b) for x in truth.flagged_spans(df, 0, 30, "g").collect()}
    want = set()
    for g in range(20):
        mine = [(t, f) for k, t, f in rows if k == g]
        mine = [(0, mine[0][1]), *mine, (30, mine[-1][1])]
        at = 0
        while at < len(mine):
            end = at
            while end < len(mine) and mine[end][1] == mine[at][1]:
                end += 1
            if mine[at][1]:
                want.add((g, mine[at][0] * 2000, mine[end][0] * 2000 - 1 if end < len(mine) else mine[-1][0] * 2000))
            at = end
    assert got == want
    assert truth.flagged_spans(df.where("false"), 0, 30, "g").count() == 0


def test_lookback(spark):
    row = lambda check, rate, n, s, gap: ("c", check, 0.0, 1.0, rate, None, 0.0, n, s, gap, None)
    far = lambda *rows: limits.lookback(spark.createDataFrame(list(rows), LIMITS_SCHEMA)).first()[0]
    assert far(row("limits", None, 3, None, 60.0)) == 120 and far(row("limits", 1.0, 3, None, 60.0)) == 180
    assert far(row("states", None, None, 30.0, 60.0), row("none", None, 99, None, 60.0)) == 90 and far(row("none", None, 3, None, 60.0)) == 0
