"""Literal limit-check vectors as DataFrames, for the batch windows and for the stateful channel, and random streams between the two."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.grades import QUALITIES
from tidewatch.operators import arbiter, detect
from tidewatch.operators.limits import LIMITS_SCHEMA, Policy
from tidewatch.streaming.live import Channel, Kept, Processor, Refused, Rules, fresh

NAN = float("nan")
SAMPLES = "mission string, channel string, ts_us long, value double, kind string, quality string"


def rule(policy, low=0.0, high=10.0, max_rate=None, allowed=None):
    return ("ch", "states" if allowed else "limits", None if allowed else low, None if allowed else high, max_rate, allowed, policy.hysteresis, policy.samples, policy.seconds, policy.max_gap_s, None)


def run(spark, cases):
    """cases: name -> (rule, [(second, value, quality?)]). -> name -> rows in order"""
    samples, limits = [], []
    for name, (r, points) in cases.items():
        samples += [("m", name, int(p[0] * 1e6), float(p[1]), "numeric", p[2] if len(p) > 2 else "ok") for p in points]
        limits.append((name, *r[1:]))
    out = detect.scored(spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(limits, LIMITS_SCHEMA))
    rows = {n: [] for n in cases}
    for x in sorted(out.collect(), key=lambda r: r.ts_us):
        rows[x.channel].append(x)
    return rows


def stateful(r, points):
    names = ("channel", "check", "low", "high", "max_rate", "allowed", "hysteresis", "persist_n", "persist_s", "max_gap_s", "reason")
    c, out = Channel(dict(zip(names, r, strict=True)), 0.1, 0.5), []
    for p in points:
        list(c.feed(int(p[0] * 1e6), float(p[1]), p[2] if len(p) > 2 else "ok"))
        if p[1] == p[1]:
            out.append(c.onset_us)
    return out


def each(*values):
    return list(enumerate(values))


def P(h=0.0, n=1, s=None, gap=60.0):  # noqa: N802
    return Policy(h, gap, samples=None if s else n, seconds=s)


T, F_ = True, False
VECTORS = {
    "noisy": (rule(P(n=3)), each(1, 50, 1, 1, 60, 70, 1), [F_] * 7),
    "samples": (rule(P(n=3)), each(1, 11, 12, 13, 14, 1), [F_, F_, F_, T, T, F_]),
    "seconds": (rule(P(s=10.0)), [(0, 11), (5, 12), (9, 13), (10, 14), (15, 1)], [F_, F_, F_, T, F_]),
    "hysteresis": (rule(P(0.1)), each(11, 9.5, 9.1, 9.0, 9.5), [T, T, T, F_, F_]),
    "rate": (rule(P(), max_rate=1.0), each(1, 1.5, 4.0, 4.5), [F_, F_, T, F_]),
    "rate over a gap below": (rule(P(), max_rate=0.05), [(0, 0), (50, 9)], [F_, T]),
    "rate over a gap above": (rule(P(), max_rate=0.05), [(0, 0), (100, 9)], [F_, F_]),
    "gap": (rule(P(n=2)), [(0, 11), (1, 11), (2, 11), (200, 11), (201, 11)], [F_, T, T, F_, T]),
    "gap equal": (rule(P(n=2)), [(0, 11), (60, 11)], [F_, T]),
    "nan": (rule(P()), each(1, NAN, 2), [F_, F_]),
    "states": (rule(P(), allowed=[0.0, 1.0]), each(0, 1, 2, 1), [F_, F_, T, F_]),
    "states twice": (rule(P(n=2), allowed=[0.0, 1.0]), each(2, 0, 2, 2), [F_, F_, F_, T]),
    "inclusive": (rule(P()), each(0, 10, 10.0001), [F_, F_, T]),
}


def test_batches_of_any_size_give_the_same_records():
    """A channel fed in batches, cut anywhere, against one fed sample by sample."""
    r = random.Random(6)
    names = ("channel", "check", "low", "high", "max_rate", "allowed", "hysteresis", "persist_n", "persist_s", "max_gap_s", "reason")
    for case in range(60):
        own = dict(zip(names, rule(P(r.choice([0.0, 0.1]), r.randint(1, 3), r.choice([None, 4.0])), **r.choice([{}, {"max_rate": 3.0}, {"allowed": [5.0, 9.7]}])), strict=True))
        t, rows = 0, []
        for _ in range(r.randint(1, 80)):
            t += r.choice([0, 1, 1, 2, 5, 80, -1])
            rows.append((t * 10**6, r.choice([5.0, 9.7, 9.7, 11.0, 15.0, NAN]), r.choice([0, 1])))
        single, one = Channel(own, 0.1, 0.5), []
        for ts, v, q in rows:
            one += single.feed(ts, v, QUALITIES[q])
        rules, kept, many, at = Rules(own, 0.1, 0.5), Kept(), [], 0
        while at < len(rows):
            end = at + r.randint(1, 9)
            ts, v, q = (np.array(x) for x in zip(*rows[at:end], strict=True))
            new = fresh(ts, kept.seen_us)
            kept, out = rules.applied(kept, ts[new], v[new].astype(float), q[new])
            many, at = many + out, end
        assert many == one and kept == single.kept, case


def test_live_path_refuses_what_the_limits_do_not_speak_of():
    p = Processor({"a": {}}, 0.1, 0.5, "m")
    for key in (("m", "b"), ("n", "a")):
        with pytest.raises(Refused):
            next(p.handleInputRows(key, iter(()), None))


@pytest.fixture(scope="module")
def vectors(spark):
    return run(spark, {n: v[:2] for n, v in VECTORS.items()})


@pytest.mark.parametrize("name", VECTORS)
def test_vector(vectors, name):
    assert [r.firing for r in vectors[name]] == VECTORS[name][2]
    assert stateful(*VECTORS[name][:2]) == [r.onset_us for r in vectors[name]]


def test_scores_and_onsets(spark, vectors):
    rows = run(spark, {"scale": (rule(P()), each(12, -5, 10.5)), "storm": (rule(P()), each(*[10.5, 9.8] * 5)), "calm": (rule(P(0.05)), each(*[10.5, 9.8] * 5))})
    assert [r.score for r in rows["scale"]] == pytest.approx([0.2, 0.5, 0.05])
    assert len({r.onset_us for r in rows["storm"] if r.firing}) == 5 and len({r.onset_us for r in rows["calm"] if r.firing}) == 1
    assert vectors["rate"][2].score == 1.5 and vectors["samples"][3].onset_us == 1_000_000
    assert [r.onset_us for r in vectors["gap"] if r.firing] == [0, 0, 200_000_000]


def test_samples_of_one_instant_have_no_rate_limit(spark):
    rows = run(spark, {"still": (rule(P(), max_rate=1.0), [(0, 1), (0, 1), (1, 1), (1, 1), (2, 9)]), "jump": (rule(P(), max_rate=1.0), [(0, 1), (0, 9), (60, 1)])})
    assert [r.firing for r in rows["still"]] == [F_, F_, F_, F_, T] and [r.score for r in rows["still"]] == [0, 0, 0, 0, 7]
    assert [r.firing for r in rows["jump"]] == [F_, F_, F_]


def test_rate_over_no_time(spark):
    """As a division of doubles gives it: infinite, NaN if nothing changed or a value is not a number, null without a value."""
    out = {}
    for a, b in ((1.0, 3.0), (1.0, 1.0), (NAN, 1.0), (None, 1.0)):
        df = spark.createDataFrame([("c", 0, 5, a, "ok"), ("c", 0, 5, b, "ok")], "channel string, seg int, ts_us long, value double, quality string")
        first, second = detect.rated(df.coalesce(1), "channel").collect()
        assert first.rate is None and first.elapsed_us is None and second.elapsed_us == 0
        out[a, b] = str(second.rate)
    assert list(out.values()) == ["inf", "nan", "nan", "None"]


def test_quality_is_the_worst_of_what_was_used(spark):
    points = [(0, 1.0, "gap_filled"), (1, 2.0, "ok")]
    rows = run(spark, {"rate": (rule(P(), max_rate=5.0), points), "plain": (rule(P()), points)})
    assert [r.quality for r in rows["rate"]] == ["gap_filled", "gap_filled"] and [r.quality for r in rows["plain"]] == ["gap_filled", "ok"]


def test_random_streams_agree_with_the_state_machine(spark):
    r, cases = random.Random(20260928), {}
    for k in range(120):
        policy = P(r.choice([0.0, 0.05, 0.2]), r.choice([1, 2, 3]), r.choice([None, None, 4.0]), r.choice([3.0, 10.0]))
        at, points = 0, []
        for _ in range(40):
            at += r.choice([1, 1, 1, 2, 3, 4, 11])
            points.append((at, r.choice([5.0, 9.6, 9.0, 10.5, -1.0, 12.0, NAN])))
        cases[f"c{k}"] = (rule(policy, max_rate=r.choice([None, 2.0])), points)
    for name, rows in run(spark, cases).items():
        assert [x.onset_us for x in rows] == stateful(*cases[name]), name


def test_causality(spark):
    points = each(*[random.Random(1).choice([5.0, 11.0, 9.7]) for _ in range(60)])
    whole = run(spark, {"a": (rule(P(0.05, 2)), points)})["a"]
    part = run(spark, {"a": (rule(P(0.05, 2)), points[:30] + [(t, 99.0) for t, _ in points[30:]])})["a"]
    assert whole[:30] == part[:30]


def test_one_exchange(spark):
    df = spark.createDataFrame([("m", "a", 1, 1.0, "numeric", "ok")], SAMPLES)
    own = spark.createDataFrame([("a", *rule(P())[1:])], LIMITS_SCHEMA)
    plan = detect.scored(df, own.hint("broadcast"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_lookback():
    assert [P(n=3).lookback_s(), P(s=30.0).lookback_s(), P(n=3).lookback_s(True), P(n=5, gap=10.0).lookback_s()] == [120, 90, 180, 40]


@pytest.mark.parametrize("bad", [{"hysteresis": 0.6}, {"samples": 0}, {"max_gap_s": 0}, {"samples": None}, {"seconds": 3.0}])
def test_policy_refusals(bad):
    with pytest.raises(ValueError):
        Policy(**({"hysteresis": 0.1, "max_gap_s": 60.0, "samples": 2} | bad))


def test_refused_samples(spark):
    rows = [("m", "a", 1, 1.0, "categorical", "ok"), ("x", "a", 2, 1.0, "numeric", "ok"), ("m", "z", 3, 1.0, "numeric", "ok"), ("m", "a", 4, 1.0, "numeric", "ok")]
    out = detect.refused(spark.createDataFrame(rows, SAMPLES), spark.createDataFrame([("a", *rule(P())[1:])], LIMITS_SCHEMA), "m")
    assert {(r.mission, r.channel, r.reason) for r in out.collect()} == {("m", "a", "numeric limits do not apply"), ("x", "a", "mission"), ("m", "z", "no entry")}


# --- alarms -------------------------------------------------------------------------------------------------------------------------------


def scored(spark, points, **k):
    samples = spark.createDataFrame([("m", "ch", int(t * 1e6), float(v), "numeric", q) for t, v, q in points], SAMPLES)
    return detect.scored(samples, spark.createDataFrame([rule(P(**k))], LIMITS_SCHEMA))


def test_alarm_lifecycle(spark):
    s = scored(spark, [(0, 1, "ok"), (1, 10.5, "ok"), (2, 12, "stale"), (3, 20, "ok"), (4, 11, "ok"), (5, 1, "ok"), (6, 15, "ok")], n=2, h=0.0)
    out = arbiter.alarms(s, 0.1, 0.5).collect()
    assert len(out) == 1
    a = out[0]
    assert (a.id, a.t_start_us, a.fired_at_us, a.t_end_us, a.delay_s, a.severity, a.quality, a.n_firing) == ("m:r0_limits:ch:19700101T000001.000000Z", 1_000_000, 2_000_000, 4_000_000, 1.0, "high", "stale", 3)
    assert a.peak == 1.0
    rec = [(r.kind, r.at_us, r.t_end_us, r.severity) for r in sorted(arbiter.records(s, 0.1, 0.5).collect(), key=lambda r: r.at_us or 10**18)]
    assert rec == [("open", 2_000_000, None, "medium"), ("rise", 3_000_000, None, "high"), ("close", 5_000_000, 4_000_000, "high")]


def test_open_at_the_end(spark):
    s = scored(spark, [(0, 11, "ok"), (1, 12, "ok")])
    assert arbiter.alarms(s, 0.1, 0.5).first().t_end_us is None
    kinds = [r.kind for r in arbiter.records(s, 0.1, 0.5).collect()]
    assert sorted(kinds) == ["finish", "open"]
    last = arbiter.final(arbiter.records(s, 0.1, 0.5), F.coalesce("at_us", F.lit(2**62))).first()
    assert last.kind == "finish" and last.peak == pytest.approx(0.2)
    events = arbiter.as_events(arbiter.alarms(s, 0.1, 0.5))
    assert events.first().channels[0].weight == 1.0
    e = arbiter.fired_by(arbiter.first_detection(events), "r0_limits").first()
    assert e.first_detection == e.fired_at == e.detections[0].fired_at and arbiter.fired_by(events, "other").first().fired_at is None


def test_repeats_and_coverage(spark):
    rows = [("m", "a", k, t, 1.0) for k, t in enumerate([1, 2, 2, 1, 3])] + [("m", "b", 9, 1, NAN)]
    df = detect.fresh(spark.createDataFrame(rows, "mission string, channel string, arrival int, ts_us long, value double"), "arrival", "mission", "channel")
    assert [r.fresh for r in df.where("channel = 'a'").orderBy("arrival").collect()] == [True, True, False, False, True]
    scores = spark.createDataFrame([("a", True), ("a", False)], "channel string, firing boolean")
    out = {r.channel: r for r in detect.coverage(df, scores, "channel").collect()}
    assert (out["a"].repeats, out["a"].scored, out["a"].ratio, out["b"].ratio) == (2, 2, pytest.approx(2 / 3), 0.0) and out[None].samples == 6
