"""Commands: ``python -m tidewatch.cli replay|detect|evaluate|derive|fetch --config FILE``. Exit codes: 0 done, 1 differs, 2 unusable input, 130 stopped."""

from __future__ import annotations

import argparse
import platform
import subprocess
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import arbiter, detect, limits, replay
from tidewatch.plans.evaluate import EvalConfig, evaluate, write
from tidewatch.sources import fetch, files, records
from tidewatch.sources.archive import Archive, Channel, IngestError
from tidewatch.streaming import pace


def session() -> SparkSession:
    return SparkSession.builder.appName("tidewatch").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def archive_of(raw: dict) -> Archive:
    raw = files.closed(raw, ("path", "mission", "channels"), "source")
    return Archive(raw["path"], raw["mission"], {n: Channel(**files.closed(c, ("kind", "unit"), f"channel {n}")) for n, c in raw["channels"].items()})


def run_replay(spark: SparkSession, config: dict, restart: bool, clock: pace.Clock | None = None, stopped: Callable[[], bool] = lambda: False) -> int:
    """Publish an archive as JSON lines in stream order, in parts that end where positions are saved.

    A part's folder is named by what was published before it, so a part that was cut short is written anew by the run that resumes. A
    position is saved when its part is whole; when the stream is complete it goes, and another run starts from the beginning.

    With a ``clock`` parts go out when due: the schedule starts now, at the position's mission time, else the window's start, else the first
    sample. A stop leaves the position, and the next run resumes there.
    """
    c = files.closed(config, ("source", "start_us", "end_us", "seed", "speed", "wall_us", "sink", "checkpoint", "every", "idle_us"), "replay")
    source = archive_of(c["source"])
    identity = replay.fingerprint(source.describe(spark), c["start_us"], c["end_us"], c["seed"])
    checkpoint = Path(c["checkpoint"])
    if restart:
        checkpoint.unlink(missing_ok=True)
    at = files.load_position(checkpoint, identity)
    anchor = at.ts_us if at and clock else c["start_us"]
    wall_us = clock.now_us() if clock else c["wall_us"]
    stream = replay.published(replay.window(source.readings(spark), c["start_us"], c["end_us"]), anchor, c["speed"], wall_us, c["seed"])
    if at is not None:
        stream = replay.after(stream, at.ts_us, at.rank)
    done = at.published if at else 0
    stream = replay.placed(stream, done).cache()
    if clock is not None:
        for part, before, last in pace.ticks(stream, done, c["every"], clock, stopped):
            _publish(part, c["sink"], before)
            files.save_position(checkpoint, files.Position(identity, last["place"], last["ts_us"], last["rank"]))
        if not stopped():
            checkpoint.unlink(missing_ok=True)
        stream.unpersist()
        return 130 if stopped() else 0
    for r in replay.checkpoints(stream, c["every"], c["idle_us"]).orderBy("place").select("place", "ts_us", "rank").collect():
        _publish(stream.where(F.col("place").between(done + 1, r["place"])), c["sink"], done)
        done = r["place"]
        files.save_position(checkpoint, files.Position(identity, done, r["ts_us"], r["rank"]))
    _publish(stream.where(F.col("place") > done), c["sink"], done)
    checkpoint.unlink(missing_ok=True)
    stream.unpersist()
    return 0


def _publish(part: DataFrame, sink: str, before: int) -> None:
    records.write_lines(records.as_samples(replay.ordered(part)), f"{sink}/after-{before:015d}", "overwrite")


def run_detect(spark: SparkSession, config: dict) -> int:
    """JSON-line samples to JSON-line events and coverage, with a run header that is written first. Of samples that don't move their
    channel forward in the order of the lines, the first arrival counts and the others are counted."""
    c = files.closed(config, ("samples", "limits", "medium", "high", "out"), "detect")
    raw = files.load_yaml(c["limits"])
    own = files.limits_frame(spark, raw)
    header = {"tool": "tidewatch", "config": c, "detectors": [{"id": arbiter.DETECTOR, "config_sha256": files.config_hash(raw)}]}
    records.write_lines(spark.createDataFrame([(files.json.dumps(header, sort_keys=True),)], "header string"), f"{c['out']}/header")
    samples = detect.fresh(records.read_lines(spark, c["samples"]), "arrival", "mission", "channel")
    if bad := detect.refused(samples, own, raw["mission"]).collect():
        raise files.ConfigError("; ".join(f"{r.mission}/{r.channel}: {r.reason}" for r in bad))
    scores = detect.scored(samples.where("fresh"), own)
    records.write_lines(arbiter.as_events(arbiter.alarms(scores, c["medium"], c["high"])).orderBy("t_start", "id"), f"{c['out']}/events")
    records.write_lines(detect.coverage(samples, scores, "channel").orderBy("channel"), f"{c['out']}/coverage")
    return 0


def run_header() -> dict:
    """What a report was made with: commit (and whether the tree differs from it), Python, machine."""
    git = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True, check=False).stdout.strip()
    return {"commit": git("rev-parse", "HEAD") or None, "dirty": bool(git("status", "--porcelain")), "python": platform.python_version(), "machine": platform.processor() or platform.machine()}


def run_evaluate(spark: SparkSession, config: dict) -> int:
    c = files.closed(config, ("source", "evaluation", "lock", "out"), "evaluate")
    source = archive_of(c["source"])
    md5 = source.digest(spark)
    if c["lock"] is not None:
        lock = files.closed(c["lock"], ("path", "dataset", "file"), "lock")
        files.check_lock(lock["path"], lock["dataset"], lock["file"], md5)
    e = dict(c["evaluation"])
    e["blocks"], e["sensitivity_s"] = tuple(tuple(b) for b in e["blocks"]), tuple(e["sensitivity_s"])
    channels = spark.createDataFrame([(n, x.kind) for n, x in source.channels.items()], "channel string, kind string")
    source.readings(spark)  # refuses an archive that isn't as declared
    result = evaluate(spark, source.labelled(spark), channels, EvalConfig(mission=source.mission, **e), md5, c["out"])
    write(result, c["out"], run_header() | {"config_sha256": files.config_hash(config), "data_md5": md5})
    return 0


def run_derive(spark: SparkSession, config: dict, check: bool) -> int:
    """Write a limits file from nominal data, or check that the file is what the data give."""
    c = files.closed(config, ("source", "margin", "defaults", "training_end_us", "official_train", "out"), "derive")
    source = archive_of(c["source"])
    policy = files.policy_of(c["defaults"])
    nominal = limits.nominal(replay.window(source.labelled(spark), None, c["training_end_us"]))
    nominal = nominal.where("train") if c["official_train"] else nominal
    channels = spark.createDataFrame([(n, x.kind) for n, x in source.channels.items()], "channel string, kind string")
    rows = limits.derived(channels, nominal.select("channel", "value"), c["margin"], policy, "channel")
    counts = {r.channel: r.n for r in limits.nominal_counts(channels, nominal, "channel").collect()}
    provenance = {"data_md5": source.digest(spark), "spec_sha256": files.config_hash(config), "margin": c["margin"], "training": {"start_us": None, "end_us": c["training_end_us"]}, "nominal": counts}
    text = files.limits_yaml(files.limits_config(rows, source.mission, policy, provenance))
    if check:
        return int(not Path(c["out"]).exists() or Path(c["out"]).read_text(encoding="utf-8") != text)
    files.write_atomic(c["out"], text)
    return 0


def run_fetch(config: dict, only: str | None, listing: bool, dry: bool, force: bool) -> int:
    """Download what a registry names, without Spark; ``listing`` and ``dry`` say what there is and what would be done."""
    c = files.closed(config, ("registry", "folder"), "fetch")
    known = fetch.registry(c["registry"])
    if only is not None and only not in known:
        raise files.ConfigError(f"{only} is not in the registry: {sorted(known)}")
    for name in [only] if only is not None else sorted(known):
        if listing or dry:
            for f in known[name]:
                here = fetch.verified(Path(c["folder"]) / name / f.file, f)
                print(f"{name}/{f.file} {':'.join(f.expected)}" if listing else f"{'keep' if here and not force else 'download'} {name}/{f.file}")
        else:
            fetch.fetch(name, known[name], c["folder"], force)
    return 0


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidewatch")
    parser.add_argument("command", choices=("replay", "detect", "evaluate", "derive", "fetch"))
    parser.add_argument("--config", required=True)
    parser.add_argument("--restart", action="store_true")
    parser.add_argument("--check", action="store_true")
    parser.add_argument("--paced", action="store_true", help="replay by the machine's clock")
    parser.add_argument("--dataset")
    for flag in ("--list", "--dry-run", "--force"):
        parser.add_argument(flag, action="store_true")
    a = parser.parse_args(args)
    try:
        config = files.load_yaml(a.config)
        if a.command == "fetch":
            return run_fetch(config, a.dataset, a.list, a.dry_run, a.force)
        spark = session()
        if a.command == "replay" and a.paced:
            with pace.Stop().on_signals() as stop:
                return run_replay(spark, config, a.restart, pace.SystemClock(), stop)
        if a.command == "replay":
            return run_replay(spark, config, a.restart)
        if a.command == "derive":
            return run_derive(spark, config, a.check)
        return {"detect": run_detect, "evaluate": run_evaluate}[a.command](spark, config)
    except KeyboardInterrupt:
        return 130
    except (OSError, ValueError, IngestError, TypeError, PySparkException) as error:
        print(f"tidewatch: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
