"""Archive checks, replay order and resume, JSON lines, the live path against the batch path, the command line, the evaluation end to end."""

from __future__ import annotations

import json
import math
import random

import pytest
import yaml
from pyspark.sql import functions as F

from tidewatch import cli
from tidewatch.functions.instants import stamp
from tidewatch.operators import arbiter, detect, replay
from tidewatch.operators.limits import LIMITS_SCHEMA
from tidewatch.plans.evaluate import EvalConfig, evaluate, repeated
from tidewatch.sources import files, records
from tidewatch.sources.archive import Archive, Channel, IngestError
from tidewatch.streaming import live, pace

S = 1_000_000
DAY = 1641326400  # 2022-01-04T20:00:00Z
HEADER = "label,segment,channel,timestamp,value,sampling,anomaly,train"
CHANNELS = {"CH_A": Channel("numeric", "T"), "CH_B": Channel("numeric"), "CH_C": Channel("categorical")}


def iso(second):
    import datetime as dt

    return (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=second)).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def segment(n, channel, sampling, anomaly, train, times, values):
    return [f"x,{n},{channel},{iso(DAY + t)},{v},{sampling},{anomaly},{train}" for t, v in zip(times, values, strict=True)]


ROWS = (
    segment(7, "CH_A", 1, 0, 1, range(5), (1.00, 1.01, 1.02, 1.03, 1.04))
    + segment(9, "CH_B", 1, 0, 0, (10801, 10802, 10803), (-2.1487e-05, -2.05077e-05, -2.10633e-05))
    + segment(5, "CH_C", 5, 1, 1, (2, 7, 13, 18, 140, 145), (0, 1, 2, 1, 0, 2))
    + segment(1, "CH_A", 1, 0, 0, (10800, 10801, 10802), (1.10, 1.11, 1.12))
    + segment(2, "CH_B", 1, 0, 1, range(5), (2.00, 2.01, 2.02, 2.03, 2.04))
)
LIMITS = {
    "mission": "test",
    "provenance": {},
    "defaults": {"hysteresis": 0.0, "persistence": {"samples": 2}, "max_gap_s": 3600.0},
    "channels": {"CH_A": {"check": "limits", "low": 0.95, "high": 1.05}, "CH_B": {"check": "limits", "low": 1.95, "high": 2.05}, "CH_C": {"check": "states", "allowed": [0, 1], "persistence": {"samples": 1}}},
}


def write(folder, rows, name="a.csv"):
    path = folder / name
    path.write_text("\n".join([HEADER, *rows]) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    return Archive(write(tmp_path_factory.mktemp("archive"), ROWS), "test", CHANNELS)


def test_readings_and_labels(spark, archive):
    r = archive.readings(spark)
    assert r.count() == 22 and not {"anomaly", "segment", "train"} & set(r.columns)
    assert r.where("channel = 'CH_B'").agg(F.min("value")).first()[0] == -2.1487e-05
    assert archive.labelled(spark).where("anomaly").count() == 6
    assert archive.describe(spark)["md5"] == archive.digest(spark)


@pytest.mark.parametrize(
    "bad", ["x,1,CH_A,2022-01-04T23:59:00.000,1.0,1,0,0", "x,1,CH_A,2022-01-04T23:59:00.000Z,nan,1,0,0", "x,1,CH_A,2022-01-04T23:59:00.000Z,x,1,0,0", ROWS[0], "x,1,CH_Z,2022-01-04T23:59:00.000Z,1.0,1,0,0"]
)
def test_refused_archives(spark, tmp_path, bad):
    with pytest.raises(IngestError):
        Archive(write(tmp_path, [*ROWS, bad]), "test", CHANNELS).readings(spark)


def test_refused_labels_channels_and_files(spark, tmp_path):
    for bad in ("x,1,CH_A,2022-01-04T23:59:00.000Z,1.0,0,0,0", "x,a,CH_A,2022-01-04T23:59:00.000Z,1.0,1,0,0", "x,1,CH_A,2022-01-04T23:59:00.000Z,1.0,1,yes,0"):
        with pytest.raises(IngestError):
            Archive(write(tmp_path, [*ROWS, bad]), "test", CHANNELS).labelled(spark)
    with pytest.raises(IngestError):
        Archive(write(tmp_path, ROWS), "test", CHANNELS | {"CH_D": Channel("numeric")}).readings(spark)
    with pytest.raises(IngestError):
        Archive(str(tmp_path / "absent.csv"), "test", CHANNELS).digest(spark)


def test_records_known_in_advance(spark, archive):
    own = files.limits_frame(spark, LIMITS)
    rec = arbiter.records(detect.scored(archive.readings(spark), own), 0.5, 0.65)
    got = {}
    for r in sorted(rec.collect(), key=lambda r: (r.channel, r.t_start_us, r.at_us or 10**18)):
        end = None if r.t_end_us is None else r.t_end_us // S - DAY
        got.setdefault((r.channel, r.t_start_us // S - DAY), []).append((end, r.severity))
    assert got == {
        ("CH_C", 13): [(None, "high"), (13, "high")],
        ("CH_C", 145): [(None, "high"), (None, "high")],
        ("CH_A", 10800): [(None, "medium"), (None, "high"), (None, "high")],
        ("CH_B", 10801): [(None, "high"), (None, "high")],
    }


def test_replay_order_schedule_and_resume(spark, archive):
    stream = replay.published(archive.readings(spark), DAY * S, 1000.0, 5 * S, seed=7)
    rows = [tuple(r) for r in replay.ordered(stream).select("ts_us", "rank", "wall_us").collect()]
    assert rows == sorted(rows) and len({r[:2] for r in rows}) == 22
    assert all(w == 5 * S + (t - DAY * S) // 1000 for t, _, w in rows)
    for k in range(0, 22, 3):
        rest = replay.ordered(replay.after(stream, *rows[k][:2])).select("ts_us", "rank", "wall_us").collect()
        assert [tuple(r) for r in rest] == rows[k + 1 :]
    a = replay.fingerprint(archive.describe(spark), None, None, 0)
    assert a == replay.fingerprint(archive.describe(spark), None, None, 0) != replay.fingerprint(archive.describe(spark), None, None, 1)
    with pytest.raises(ValueError):
        replay.window(stream, 5, 5)


def test_positions(tmp_path):
    at = files.Position("f", 3, 5, 1)
    files.save_position(tmp_path / "c", at)
    assert files.load_position(tmp_path / "c", "f") == at and files.load_position(tmp_path / "none", "f") is None
    with pytest.raises(files.ConfigError):
        files.load_position(tmp_path / "c", "g")
    (tmp_path / "c").write_text("{")
    with pytest.raises(files.ConfigError):
        files.load_position(tmp_path / "c", "f")


def test_lines_round_trip(spark, archive, tmp_path):
    stream = replay.offline(archive.readings(spark))
    records.write_lines(records.as_samples(stream), str(tmp_path / "lines"))
    back = records.read_lines(spark, str(tmp_path / "lines"))
    cols = ["channel", "ts_us", "wall_us", "value", "kind", "unit", "quality"]
    assert sorted(map(str, back.select(cols).collect())) == sorted(map(str, stream.select(cols).collect()))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"mission": "m", "extra": 1}\n')
    with pytest.raises(Exception, match="unusable sample"):
        records.read_lines(spark, str(tmp_path / "bad")).collect()


def test_stamp(spark):
    assert spark.range(1).select(stamp(F.lit(1705276800123456))).first()[0] == "20240115T000000.123456Z"


def test_live_equals_batch_and_repeats_are_harmless(spark, tmp_path):
    r, rows = random.Random(4), []
    for c in ("a", "b", "c"):
        t = 0
        for _ in range(150):
            t += r.choice([1, 1, 2, 5, 80]) * S
            rows.append(("m", c, t, r.choice([5.0, 9.7, 11.0, 15.0, float("nan")]), "numeric", r.choice(["ok", "stale"])))
    samples = spark.createDataFrame(rows, "mission string, channel string, ts_us long, value double, kind string, quality string")
    own = spark.createDataFrame([(c, "limits", 0.0, 10.0, n, None, 0.05, 2, None, 60.0, None) for c, n in (("a", None), ("b", 3.0), ("c", None))], LIMITS_SCHEMA)
    live.feed_files(samples, str(tmp_path / "in"), 3)
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    found = live.detected(stream, own, 0.1, 0.5)
    start = lambda: found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    start().awaitTermination()
    published = spark.read.schema(live.RECORD_SCHEMA).parquet(str(tmp_path / "out")).unionByName(live.still_open(spark, str(tmp_path / "cp")))
    cols = ["channel", "kind", "at_us", "t_start_us", "t_end_us", "fired_at_us", "severity", "quality"]
    batch = arbiter.records(detect.scored(samples, own), 0.1, 0.5)
    before = sorted(map(str, published.select(cols).collect()))
    assert before == sorted(map(str, batch.select(cols).collect()))
    samples.limit(60).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start().awaitTermination()
    again = spark.read.schema(live.RECORD_SCHEMA).parquet(str(tmp_path / "out")).unionByName(live.still_open(spark, str(tmp_path / "cp")))
    assert sorted(map(str, again.select(cols).collect())) == before


# --- end to end -----------------------------------------------------------------------------------------------------------------------------

B1, B2 = DAY + 4 * 3600, DAY + 5 * 3600


def end_to_end_rows():
    rows, n, count = [], [0], {}

    def add(channel, start, values, anomaly, train=0):
        n[0] += 1
        extra = values if isinstance(values, list) else None
        for i, v in enumerate(extra):
            t, v = v if isinstance(v, tuple) else (start + i, v)
            rows.append((n[0], channel, int(t * S), float(v), 1, bool(anomaly), bool(train)))

    def nominal(channel, start, segments, train=0, spike=None):
        count["i"] = 0
        for k in range(segments):
            values = [round(0.5 + 0.4 * math.sin((count["i"] + i) / 7), 6) for i in range(60)]
            count["i"] += 60
            if k == 0 and spike is not None:
                values[spike] = 1.5
            add(channel, start + 60 * k, values, 0, train)

    for c in "AB":
        nominal(c, DAY, 10, 1)
    nominal("A", B1, 2)
    add("A", B1 + 120, [5.0] * 30, 1)
    nominal("A", B1 + 150, 2)
    nominal("B", B1, 1, spike=30)
    nominal("B", B1 + 60, 4)
    add("B", B1 + 300, [round(5 + 0.1 * i, 1) for i in range(10)], 1)
    nominal("A", B2, 5)
    nominal("B", B2, 2)
    add("B", B2 + 120, [(B2 + 120 + i + (99 if i >= 15 else 0), 5.0) for i in range(30)], 1)
    nominal("B", B2 + 250, 2)
    add("A", B2 + 1200, [5.0] * 10, 1)
    return rows


def test_evaluation_known_in_advance(spark, tmp_path):
    samples = spark.createDataFrame(end_to_end_rows(), "segment int, channel string, ts_us long, value double, sampling_s int, anomaly boolean, train boolean")
    channels = spark.createDataFrame([("A", "numeric"), ("B", "numeric")], "channel string, kind string")
    config = EvalConfig("m", ((B1 * S, (B1 + 600) * S), (B2 * S, (B2 + 600) * S)), 0.1, 0.05, 3, 60.0, (60.0, 150.0), 0.1, 0.5, cpu_min_s=1e-9)
    e = evaluate(spark, samples, channels, config, events_to=tmp_path)
    assert e.timing["passes"] == 1 and e.timing["cpu_s"] > 0 and e.timing["millicores_per_channel"] > 0
    sent = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "events-1")).collect()]
    assert [x["id"] for x in sorted(sent, key=lambda x: (x["t_start"], x["id"]))] == [x["id"] for x in sent] and len(sent) == 2
    assert (e.lookback_s, e.longest_event_s) == (300, 128)
    one, two = e.folds
    assert (one["tp"], one["fp"], one["fn"], one["redundant"], one["alarms"], one["recall"]) == (2, 0, 0, 0, 2, 1.0)
    assert one["alarm_delay_n"] == 2 and one["alarm_delay_median_s"] == 2.0 and one["firing_delay_median_s"] == 2.0 and one["adtqc"] == 1.0 and one["adtqc_after"] == 2 and one["channel_f"] == 1.0
    assert one["observed_s"] == 309 and one["samples"] == 580 and one["alarms_per_day"] == 2 * 86400 / 309
    assert one["cannot_fire"] == [] and two["cannot_fire"] == ["A"]
    assert two["gaps"][60.0]["alarms"] == 2 and two["gaps"][150.0]["alarms"] == 1
    assert two["gaps"][60.0]["redundant"] == 1 and two["gaps"][150.0]["redundant"] == 0 and two["gaps"][60.0]["alarming_precision"] == 0.5
    o = e.official
    assert o["anomalous"] == 4 and o["accuracy"] == o["mcc"] == o["roc_auc"] == o["average_precision"] == 1.0
    s = next(x for x in e.summary if x["measure"] == "alarming_precision")
    assert (s["n"], s["mean"], s["min"], s["max"]) == (2, 0.75, 0.5, 1.0)
    assert abs(e.limits[1]["channels"]["B"]["high"] - 0.98) < 0.01 and abs(e.limits[2]["channels"]["B"]["high"] - 1.64) < 0.01


def test_commands(spark, archive, tmp_path, monkeypatch):
    source = {"path": archive.path, "mission": "test", "channels": {n: {"kind": c.kind, "unit": c.unit} for n, c in CHANNELS.items()}}
    put = lambda name, x: (tmp_path / name).write_text(yaml.safe_dump(x)) and str(tmp_path / name)
    c = put("replay.yaml", {"source": source, "start_us": None, "end_us": None, "seed": 0, "speed": 1000.0, "wall_us": 0, "sink": str(tmp_path / "sent"), "checkpoint": str(tmp_path / "cp.json"), "every": 5, "idle_us": S})
    saved, whole, publish = [], files.save_position, cli._publish
    monkeypatch.setattr(files, "save_position", lambda path, at: (saved.append(at.published), whole(path, at)))
    sent = lambda: [r.value for r in spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "sent")).collect()]
    assert cli.main(["replay", "--config", c]) == 0 and saved == [5, 10, 15, 16, 20] and not (tmp_path / "cp.json").exists()
    first = sorted(sent())
    # Stopped at the third part, a run resumes there; complete, it starts anew. The lines are the same.
    calls = []

    def stopped(part, sink, before):
        calls.append(before)
        if calls == [0, 5, 10]:
            raise KeyboardInterrupt
        publish(part, sink, before)

    monkeypatch.setattr(cli, "_publish", stopped)
    assert cli.main(["replay", "--config", c]) == 130 and json.loads((tmp_path / "cp.json").read_text())["published"] == 10
    assert cli.main(["replay", "--config", c]) == 0 and calls[3:] == [10, 15, 16, 20] and sorted(sent()) == first and len(first) == 22
    limits = put("limits.yaml", LIMITS)
    d = put("detect.yaml", {"samples": str(tmp_path / "sent"), "limits": limits, "medium": 0.5, "high": 0.65, "out": str(tmp_path / "found")})
    assert cli.main(["detect", "--config", d]) == 0 and spark.read.text(str(tmp_path / "found/events")).count() == 4
    resent = [json.loads(x) for x in first][10:15]
    (tmp_path / "sent" / "late").mkdir()
    (tmp_path / "sent" / "late" / "z.json").write_text("\n".join(map(json.dumps, resent)))
    e = put("again.yaml", {"samples": str(tmp_path / "sent"), "limits": limits, "medium": 0.5, "high": 0.65, "out": str(tmp_path / "refound")})
    assert cli.main(["detect", "--config", e]) == 0 and sorted(r.value for r in spark.read.text(str(tmp_path / "refound/events")).collect()) == sorted(r.value for r in spark.read.text(str(tmp_path / "found/events")).collect())
    total = next(r for r in spark.read.json(str(tmp_path / "refound/coverage")).collect() if r.channel is None)
    assert (total.samples, total.repeats) == (27, 5)
    v = {"source": source, "margin": 0.1, "defaults": LIMITS["defaults"], "training_end_us": None, "official_train": True, "out": str(tmp_path / "own.yaml")}
    assert cli.main(["derive", "--config", put("derive.yaml", v)]) == 0 and cli.main(["derive", "--check", "--config", str(tmp_path / "derive.yaml")]) == 0
    (tmp_path / "own.yaml").write_text("changed")
    assert cli.main(["derive", "--check", "--config", str(tmp_path / "derive.yaml")]) == 1
    assert cli.main(["detect", "--config", put("bad.yaml", {"limits": 1})]) == 2


def test_paced_replay(spark, archive, tmp_path):
    source = {"path": archive.path, "mission": "test", "channels": {n: {"kind": c.kind, "unit": c.unit} for n, c in CHANNELS.items()}}
    c = {"source": source, "start_us": None, "end_us": None, "seed": 0, "speed": 1000.0, "wall_us": 0, "sink": str(tmp_path / "sent"), "checkpoint": str(tmp_path / "cp.json"), "every": 8, "idle_us": S}
    lines = lambda: [json.loads(r.value) for r in spark.read.option("recursiveFileLookup", True).text(c["sink"]).collect()]
    clock = pace.SimulatedClock(10 * S)
    # A stop after the third part leaves its position; the next run goes on from there, on a schedule of its own.
    asked = iter([False] * 6 + [True] * 9)
    assert cli.run_replay(spark, c, False, clock, lambda: next(asked)) == 130
    at, before = json.loads((tmp_path / "cp.json").read_text()), clock.at_us
    some = lines()
    assert len(some) == at["published"] < 22 and before > 10 * S
    clock = pace.SimulatedClock(10**12)
    assert cli.run_replay(spark, c, False, clock) == 0 and not (tmp_path / "cp.json").exists()
    out = lines()
    assert len(out) == 22 and len({(x["channel"], x["mission_ts"]) for x in out}) == 22
    # The silence of 10,800 s less 145 s takes as long on the clock, a thousandth of it.
    late = max(x["wall_ts"] for x in out)
    assert late == max(out, key=lambda x: x["mission_ts"])["wall_ts"] and clock.at_us > 10**12 + 10 * S
    # A clock far ahead: everything is late, all goes out in as few parts as ``every`` allows.
    ahead = replay.placed(replay.published(archive.readings(spark), None, 1000.0, 0)).cache()
    assert [last["place"] for _, _, last in pace.ticks(ahead, 0, 8, pace.SimulatedClock(10**15), lambda: False)] == [8, 16, 22]


def test_stop_on_signals():
    import os
    import signal

    with pace.Stop().on_signals() as stop:
        assert not stop()
        os.kill(os.getpid(), signal.SIGTERM)
        assert stop()
        pace.SystemClock().wait(2**62, stop)  # a stop ends a wait
        with pytest.raises(KeyboardInterrupt):
            os.kill(os.getpid(), signal.SIGTERM)
    began = pace.SystemClock().now_us()
    pace.SystemClock().wait(began + 30_000, lambda: False)
    assert pace.SystemClock().now_us() >= began + 30_000


def test_passes_must_agree(spark):
    import random as chance

    same = spark.range(1000).selectExpr("id", "sqrt(id) as x")
    assert repeated(spark, same, 0.02)["alarms"] == 1000 and repeated(spark, same, 0.0)["passes"] == 1
    drawn = F.udf(lambda _: chance.random(), "double").asNondeterministic()
    with pytest.raises(files.ProtocolError):
        repeated(spark, spark.range(10).withColumn("x", drawn("id")), 1e6)


def test_fetch(tmp_path, capsys):
    import hashlib

    (tmp_path / "far.csv").write_bytes(b"a,b")
    remote = {"file": "near.csv", "url": (tmp_path / "far.csv").as_uri(), "checksum": hashlib.md5(b"a,b").hexdigest()}
    put = lambda **change: (tmp_path / "r.yaml").write_text(yaml.safe_dump({"d": {"files": [remote | change]}}))
    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"registry": str(tmp_path / "r.yaml"), "folder": str(tmp_path / "data")}))
    run = lambda *more: cli.main(["fetch", "--config", str(tmp_path / "c.yaml"), *more])
    put()
    assert run("--dry-run") == 0 and capsys.readouterr().out == "download d/near.csv\n" and not (tmp_path / "data").exists()
    assert run("--dataset", "d") == 0 and (tmp_path / "data/d/near.csv").read_bytes() == b"a,b"
    files.check_lock(tmp_path / "data/lock.json", "d", "near.csv", remote["checksum"])
    assert run("--dry-run") == 0 and capsys.readouterr().out == "keep d/near.csv\n"
    assert run("--list") == 0 and remote["checksum"] in capsys.readouterr().out
    (tmp_path / "far.csv").write_bytes(b"other")
    assert run() == 0 and run("--force") == 2 and (tmp_path / "data/d/near.csv").read_bytes() == b"a,b" and not list((tmp_path / "data/d").glob("*.part"))
    assert run("--dataset", "e") == 2
    for change in ({"file": "../x"}, {"checksum": "odd:1"}):
        put(**change)
        assert run() == 2


def test_protocol_files(tmp_path):
    lock = tmp_path / "lock.json"
    lock.write_text(json.dumps({"d": {"files": [{"file": "f", "checksum": "md5:abc"}, {"file": "g", "checksum": "sha1:x"}]}}))
    files.check_lock(lock, "d", "f", "abc")
    for args in (("d", "f", "other"), ("d", "g", "x"), ("d", "none", "x"), ("e", "f", "abc")):
        with pytest.raises(files.ProtocolError):
            files.check_lock(lock, *args)
    own = {"provenance": {"data_md5": "abc", "training": {"end_us": 10}}}
    files.check_provenance(own, "abc", 10)
    for md5, end in (("abd", 10), ("abc", 9)):
        with pytest.raises(files.ProtocolError):
            files.check_provenance(own, md5, end)


@pytest.mark.parametrize("change", [{"check": "limits", "low": 2, "high": 1}, {"check": "limits", "low": 0, "high": 1, "max_rate": 0}, {"check": "states", "allowed": []}, {"check": "none"}, {"check": "odd"}, {"check": "limits", "low": 0, "high": 1, "x": 1}])
def test_refused_limits(change):
    with pytest.raises(ValueError):
        files.limits_rows(LIMITS | {"channels": {"CH_A": change}})
