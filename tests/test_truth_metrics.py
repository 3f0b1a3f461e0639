"""Ground truth, interval algebra against a half-point model, metrics against sequential versions and pinned values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import intervals
from tidewatch.operators import limits, metrics, truth

S = 1_000_000
SEG = "segment int, channel string, start_us long, end_us long, anomaly boolean, sampling_s int"


def seg(spark, rows):
    return spark.createDataFrame([(i, c, a * S, b * S, x, p) for i, c, a, b, x, p in rows], SEG)


def test_labelled_events(spark):
    rows = [(10, "A", 0, 100, False, 5), (11, "A", 105, 205, True, 5), (12, "A", 210, 310, True, 5), (13, "A", 315, 415, False, 5), (14, "A", 420, 520, True, 5)]
    out = truth.labelled_events(truth.runs(seg(spark, rows), 2)).orderBy("start_us").collect()
    assert [(r.id, r.start_us // S, r.end_us // S, r.segments) for r in out] == [("A:11", 105, 310, [11, 12]), ("A:14", 420, 520, [14])]


def test_runs_break_beyond_the_later_segments_period(spark):
    r = truth.runs(seg(spark, [(1, "A", 0, 100, True, 5), (2, "A", 110, 210, True, 5), (3, "A", 221, 321, True, 5)]), 2)
    assert [x.run for x in r.orderBy("segment").collect()] == [0, 0, 1]
    r = truth.runs(seg(spark, [(1, "A", 0, 100, True, 5), (2, "A", 103, 203, True, 1)]), 2)
    assert truth.labelled_events(r).count() == 2


def test_segments_mixed(spark):
    rows = [(1, "A", 5, 1.0, 1, False, True), (1, "A", 9, 1.0, 1, True, True), (2, "A", 7, 1.0, 1, True, True)]
    df = spark.createDataFrame(rows, "segment int, channel string, ts_us long, value double, sampling_s int, anomaly boolean, train boolean")
    assert {(r.segment, r.mixed, r.samples) for r in truth.segments(df).collect()} == {(1, True, 2), (2, False, 1)}


def test_observed_boundaries(spark):
    spans = spark.createDataFrame([(0, 10 * S), (10 * S, 20 * S), (30 * S, 40 * S)], "start_us long, end_us long")
    blocks = spark.createDataFrame([(1, 5 * S, 35 * S)], "block int, block_start_us long, block_end_us long")
    assert truth.observed_seconds(spans, blocks).first().observed_s == 20.0
    ev = spark.createDataFrame([("ends on", 0, 5 * S), ("starts on", 5 * S, 9 * S), ("cut", 34 * S, 36 * S)], "id string, start_us long, end_us long")
    assert {r.id for r in truth.straddling(ev, blocks).collect()} == {"ends on", "cut"}


def points(spans, top=60):
    return {x for x in range(-4, top) if any(a <= x <= b for a, b in spans)}


def test_lengths_are_exact_at_real_instants(spark):
    at = 1_705_276_800_123_456_789
    rows = [(2 * at, 2 * (at + n)) for n in (0, 1, 2, 1000, 1001, 3072)] + [(2 * at + 1, 2 * (at + 7) - 1)]
    out = spark.createDataFrame(rows, "a long, b long").select(intervals.length(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r.n for r in out] == [0, 1, 2, 1000, 1001, 3072, 7]


def test_interval_algebra_against_points(spark):
    r, rows = random.Random(20260928), []
    for g in range(60):
        for side in ("l", "r"):
            for _ in range(r.randint(1, 5)):
                lo, up = r.randint(0, 20), r.randint(0, 25)
                rows.append((g, side, lo * 2 + r.randint(0, 1), up * 2 - r.randint(0, 1)))
    df = spark.createDataFrame(rows, "g int, side string, a long, b long").cache()
    left, right = df.where("side = 'l'").drop("side"), df.where("side = 'r'").drop("side")
    frame = spark.createDataFrame([(g, 0, 50) for g in range(60)], "g int, a long, b long")
    both, one, less, rest = ({}, {}, {}, {})
    for out, made in ((both, intervals.intersection(left, right, 7, "g")), (one, intervals.union(left, "g")), (less, intervals.difference(frame, left, 7, "g")), (rest, intervals.difference(right, left, 7, "g"))):
        for x in made.collect():
            out.setdefault(x.g, []).append((x.a, x.b))
    for g in range(60):
        ls, rs = ([(a, b) for k, s, a, b in rows if k == g and s == side] for side in ("l", "r"))
        assert points(one.get(g, [])) == points(ls)
        assert points(both.get(g, [])) == points(ls) & points(rs)
        assert points(less.get(g, [])) == set(range(0, 51)) - points(ls)
        assert points(rest.get(g, [])) == points(rs) - points(ls)
        merged = sorted(one.get(g, []))
        assert all(b + 1 < a2 for (_, b), (a2, _) in zip(merged, merged[1:], strict=False))


def test_spans_without_key_go_by_stretches(spark):
    r = random.Random(4)
    for n in (0, 1, 40):
        rows = [(a, a + r.randint(-2, 9)) for a in (r.randint(0, 300) for _ in range(n))]
        df = spark.createDataFrame(rows, "a long, b long")
        one = sorted((x.a, x.b) for x in intervals.union(df, stretch=16).collect())
        assert points(one, 510) == points(rows, 510) and all(b + 1 < a2 for (_, b), (a2, _) in zip(one, one[1:], strict=False))
        for lo, hi in ((0, 300), (50, 60), (400, 500)):
            assert points([(x.a, x.b) for x in intervals.complement(df, lo, hi, stretch=16).collect()], 510) == set(range(lo, hi + 1)) - points(rows, 510)


def test_curve_by_buckets_equals_one_pass(spark):
    r = random.Random(5)
    rows = [(r.random() < 0.3, float(r.randint(0, 900)) / 7) for _ in range(3000)] + [(True, float("inf")), (False, None)]
    df = spark.createDataFrame(rows, "label boolean, score double")
    got = {x.score: (x.tp, x.fp) for x in metrics.curve(df).collect()}
    for s in got:
        above = rows if s is None else [x for x in rows if x[1] is not None and x[1] >= s]
        assert got[s] == (sum(x[0] for x in above), sum(not x[0] for x in above))
    assert metrics.curve(df.where("false")).count() == 0


ALARM = "channel string, t_start_us long, t_end_us long, fired_at_us long"
EVENT = "id string, channel string, start_us long, end_us long"


def test_redundant_detections(spark):
    ev = spark.createDataFrame([("id_0", "c", 100 * S, 200 * S), ("id_0", "c", 400 * S, 500 * S)], EVENT)
    al = spark.createDataFrame([("c", a * S, b * S, a * S) for a, b in ((120, 140), (160, 180), (420, 440), (460, 480))], ALARM)
    out = metrics.event_wise(ev, al, 0, 1000 * S, 0.5).first()
    assert (out.tp, out.fp, out.fn, out.redundant) == (1, 0, 0, 2) and out.precision == 1.0 and out.alarming_precision == pytest.approx(1 / 3)


def test_corrected_precision(spark):
    ev = spark.createDataFrame([("x", "c", 100 * S, 200 * S), ("y", "d", 700 * S, 710 * S)], EVENT)
    al = spark.createDataFrame([("c", 150 * S, 300 * S, 160 * S), ("d", 900 * S, None, 900 * S)], ALARM)
    out = metrics.event_wise(ev, al, 0, 1000 * S, 0.5).first()
    nominal, false = 890.0, 100.0 + 1e-9 + 100.0
    assert (out.tp, out.fp, out.fn) == (1, 1, 1) and out.tnr == pytest.approx(1 - false / nominal, rel=1e-12) and out.precision == pytest.approx(0.5 * out.tnr)
    assert metrics.event_wise(ev, al.where("false"), 0, 1000 * S, 0.5).first().tnr is None


def test_point_annotation_is_widened(spark):
    ev = spark.createDataFrame([("p", "c", 100 * S, 100 * S)], EVENT)
    al = spark.createDataFrame([("c", 100 * S + 500, 101 * S, 100 * S + 500)], ALARM)
    out = metrics.channel_aware(ev, al, spark.createDataFrame([("c",)], "channel string"), 1000 * S, 0.5).first()
    assert out.recall == 1.0 and metrics.event_wise(ev, al, 0, 1000 * S, 0.5).first().tp == 0


def test_timing_and_channel_aware_against_sequential(spark):
    r = random.Random(3)
    for _ in range(4):
        ev = [(f"e{k}", r.choice("ab"), 1000 * k + r.randint(0, 300), 1000 * k + 300 + r.randint(0, 600)) for k in range(8)]
        al = sorted({(c, 400 * k + r.randint(0, 99)) for k in range(20) for c in "abc" if r.random() < 0.3})
        al = [(c, a, a + r.randint(0, 200), a) for c, a in al]
        events = spark.createDataFrame([(i, c, a * S, b * S) for i, c, a, b in ev], EVENT)
        alarms = spark.createDataFrame([(c, a * S, b * S, f * S) for c, a, b, f in al], ALARM)
        got = {x.id: (x.latency_s, x.quality) for x in metrics.timing(events, alarms, 9000 * S, 2.0).collect()}
        starts, want = sorted({a for _, _, a, _ in ev}), {}
        for i, c, a, b in ev:
            first = [x for ch, x, y, _ in al if ch == c and x <= b and y + 1e-9 > a]
            if first:
                n, at = b - a, starts.index(a)
                alpha = min(n, a - (starts[at - 1] if at else a - n))
                lat = min(first) - a
                want[i] = (lat, 1.0 if (alpha == 0 or n == 0) and lat == 0 else 0.0 if lat <= -alpha or lat >= n else ((lat + alpha) / alpha) ** 2 if lat <= 0 else 1 / (1 + (lat / (n - lat)) ** 2))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
        channels = spark.createDataFrame([("a",), ("b",), ("c",)], "channel string")
        for x in metrics.channel_aware(events, alarms, channels, 9000 * S, 0.5).collect():
            _, c, a, b = next(e for e in ev if e[0] == x.id)
            hit = {ch: [(max(a, p), min(b, q)) for k, p, q, _ in al if k == ch and p <= b and q >= a] for ch in "abc"}
            excused = {ch: any(k == ch and i != x.id and lo <= q and hi >= p for i, k, p, q in ev for lo, hi in hit[ch]) for ch in "abc"}
            assert (x.tp, x.fn) == (int(bool(hit[c])), int(not hit[c])) and x.fp == sum(bool(hit[ch]) and not excused[ch] for ch in "abc" if ch != c)


def test_delays(spark):
    ev = spark.createDataFrame([("a", "c", 10 * S, 20 * S), ("b", "c", 50 * S, 60 * S), ("z", "d", 10 * S, 20 * S)], EVENT)
    al = spark.createDataFrame([("c", 5 * S, 10 * S, 8 * S), ("c", 12 * S, 13 * S, 13 * S), ("c", 30 * S, None, 31 * S)], ALARM)
    assert {(r.id, r.delay_s) for r in metrics.alarm_delays(ev, al).collect()} == {("a", -2.0), ("b", -19.0)}


def test_distribution(spark):
    r = metrics.distribution(spark.createDataFrame([(float(x),) for x in range(1, 11)], "v double"), "v").first()
    assert (r.n, r.median, r.p90, r.max) == (10, 5.5, 9.0, 10.0)
    r = metrics.distribution(spark.createDataFrame([], "v double"), "v").first()
    assert (r.n, r.median, r.p90, r.max) == (0, None, None, None)


PINNED = [
    ("10110010", "10011010", [0.9, 0.1, 0.4, 0.8, 0.7, 0.2, 0.9, 0.4], (0.75, 0.75, 0.75, 0.75, 0.5, 0.90625, 0.9166666666666666)),
    ("0101100010", "0111000010", [0.5, 0.5, 0.5, 1, 0, 0, 0.5, 0, 1, 0.5], (0.8, 0.75, 0.75, 0.75, 0.5833333333333334, 0.7083333333333333, 0.7071428571428571)),
    ("01001", "00000", [0.0] * 5, (0.6, 0, 0, 0, 0, 0.5, 0.4)),
]


@pytest.mark.parametrize(("labels", "flags", "scores", "want"), PINNED)
def test_classification(spark, labels, flags, scores, want):
    df = spark.createDataFrame([(a == "1", b == "1", float(s)) for a, b, s in zip(labels, flags, scores, strict=True)], "label boolean, flagged boolean, score double")
    c, curve = metrics.confusion(df).first(), metrics.curve(df)
    got = (c.accuracy, c.precision, c.recall, c.f1, c.mcc, metrics.roc_auc(curve).first()[0], metrics.average_precision(curve).first()[0])
    assert got == pytest.approx(want, abs=1e-12)


def test_derived_limits_rule_order(spark):
    channels = spark.createDataFrame([("t", "telecommand"), ("e", "numeric"), ("c", "categorical"), ("k", "numeric"), ("n", "counter")], "channel string, kind string")
    values = spark.createDataFrame([("t", 1.0), ("c", 2.0), ("c", 1.0), ("c", 2.0), ("k", 5.0), ("n", 0.0), ("n", 10.0)], "channel string, value double")
    out = {r.channel: r for r in limits.derived(channels, values, 0.1, limits.Policy(0.0, 60.0, samples=1), "channel").collect()}
    assert [out[x].check for x in "teckn"] == ["none", "none", "states", "none", "limits"] and out["c"].allowed == [1.0, 2.0] and (out["n"].low, out["n"].high) == (-1.0, 11.0)
    samples = spark.createDataFrame([("n", 11.0), ("n", 0.0), ("c", 1.0), ("c", 3.0), ("t", 9.0)], "channel string, value double")
    assert {r.channel: r.cannot_fire for r in limits.cannot_fire(samples, spark.createDataFrame(list(out.values()), limits.LIMITS_SCHEMA), "channel").collect()} == {"n": True, "c": False, "t": True}
