"""Walk-forward evaluation: folds and policies in one scoring job, metrics a fold, the official split, a report.

A fold's detector is fitted on nominal data before the embargo and starts cold in its block, so samples are cut to blocks before any
window. Fold and policy are key columns of one plan; what reaches the driver is a row a fold and policy.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import intervals
from tidewatch.functions.instants import SECOND
from tidewatch.operators import arbiter, detect, metrics, truth
from tidewatch.operators.limits import LIMITS_SCHEMA, Policy, cannot_fire, derived, nominal_counts
from tidewatch.sources.files import ProtocolError, check_provenance, config_hash, limits_config, limits_rows, limits_yaml, write_atomic
from tidewatch.sources.records import write_lines


@dataclass(frozen=True)
class EvalConfig:
    mission: str
    blocks: tuple[tuple[int, int], ...]
    margin: float
    hysteresis: float
    samples: int
    max_gap_s: float
    sensitivity_s: tuple[float, ...]
    medium: float
    high: float
    beta: float = 0.5
    exponent: float = 2.0
    run_gap_periods: float = 2.0
    min_events: int = 1
    official_train_only: bool = False
    cpu_min_s: float = 0.0

    def __post_init__(self) -> None:
        if self.max_gap_s not in self.sensitivity_s:
            raise ProtocolError("the headline max_gap_s must be one of the sensitivity runs")
        if not 0 < self.medium <= self.high:
            raise ProtocolError("bands must be positive, medium not above high")
        edges = [x for b in self.blocks for x in b]
        if edges != sorted(edges) or any(a >= b for a, b in self.blocks):
            raise ProtocolError("blocks must be ordered and disjoint")

    def policy(self, max_gap_s: float | None = None) -> Policy:
        return Policy(self.hysteresis, max_gap_s or self.max_gap_s, samples=self.samples)


@dataclass
class Evaluation:
    lookback_s: float
    longest_event_s: float
    folds: list[dict] = field(default_factory=list)
    official: dict = field(default_factory=dict)
    summary: list[dict] = field(default_factory=list)
    limits: dict[int, dict] = field(default_factory=dict)
    timing: dict = field(default_factory=dict)


MEASURES = ["precision", "recall", "f", "alarming_precision", "tnr", "adtqc", "channel_f", "alarm_delay_median_s", "alarms_per_day"]


def evaluate(spark: SparkSession, samples: DataFrame, channels: DataFrame, config: EvalConfig, data_md5: str = "", events_to: str | Path | None = None) -> Evaluation:
    """samples(segment, channel, ts_us, value, sampling_s, anomaly, train), channels(channel, kind) -> the evaluation.

    What scores is what a fold's limits file says when it is read back. ``events_to``: folder that gets the headline events of each fold.
    """
    samples = samples.withColumn("mission", F.lit(config.mission)).withColumn("quality", F.lit("ok"))
    found = truth.segments(samples)
    if mixed := found.where("mixed").limit(3).collect():
        raise ProtocolError(f"segments with rows of several channels or labels: {[r.segment for r in mixed]}")
    runs = truth.runs(found, config.run_gap_periods)
    events = truth.labelled_events(runs)
    lookback = max(config.policy(g).lookback_s() for g in config.sensitivity_s)
    first = truth.embargo(lookback, events).first()
    if first["embargo_s"] is None:
        raise ProtocolError("no labelled event")
    gap_us = round(first["embargo_s"] * SECOND)
    rows = [(k, a, b, a - gap_us) for k, (a, b) in enumerate(config.blocks, 1)]
    blocks = spark.createDataFrame(rows, "block int, block_start_us long, block_end_us long, training_end_us long")
    _refuse(truth.straddling(events, blocks).select("block", F.format_string("event %s lies on its edge %d", "id", "boundary_us").alias("why")))
    nominal = samples.where(~F.col("anomaly") & (F.col("train") | F.lit(not config.official_train_only)))
    nominal = nominal.select("channel", "ts_us", "value").join(F.broadcast(blocks), F.col("ts_us") < F.col("training_end_us"))
    tested = truth.in_blocks(samples.drop("block"), blocks, "ts_us")
    own_events = truth.in_blocks(events, blocks)
    few = blocks.join(own_events.groupBy("block").agg(F.count("*").alias("n")), "block", "left").fillna(0, ["n"]).where(F.col("n") < config.min_events)
    bare = tested.select("block", "channel").distinct().join(nominal, ["block", "channel"], "left_anti")
    _refuse(few.select("block", F.format_string("%d events are too few", "n").alias("why")).unionByName(bare.select("block", F.format_string("%s was never trained", "channel").alias("why"))))
    out = Evaluation(lookback, first["longest_event_s"])
    # Limits of every fold, under every gap.
    pairs = channels.select("channel", "kind").join(F.broadcast(blocks.select("block")))
    own = derived(pairs, nominal, config.margin, config.policy(), "block", "channel").cache()
    counts = nominal_counts(pairs, nominal, "block", "channel").collect()  # a row a fold and channel
    read_back = []
    for block, _, _, training_end in rows:
        provenance = {"data_md5": data_md5, "training": {"start_us": None, "end_us": training_end}, "nominal": {r.channel: r.n for r in counts if r.block == block}}
        out.limits[block] = limits_config(own.where(F.col("block") == block), config.mission, config.policy(), provenance)
        read = yaml.safe_load(limits_yaml(out.limits[block]))
        check_provenance(read, data_md5, training_end)
        read_back += [(block, float(g), *(r | {"max_gap_s": float(g)}).values()) for r in limits_rows(read) for g in config.sensitivity_s]
    own.unpersist()
    all_limits = spark.createDataFrame(read_back, f"block int, gap_s double, {LIMITS_SCHEMA}")
    by = ("block", "gap_s", "mission", "channel")
    every = arbiter.alarms(detect.scored(tested, all_limits, by=by, on=("block", "channel")), config.medium, config.high, by=by)
    out.timing = repeated(spark, every, config.cpu_min_s)
    alarms = every.cache()
    for block, start, end, _ in rows:
        mine = all_limits.where((F.col("block") == block) & (F.col("gap_s") == config.max_gap_s))
        here = tested.where(F.col("block") == block)
        observed = truth.observed_seconds(truth.run_spans(runs), blocks.where(F.col("block") == block)).first()
        if observed is None or not observed.observed_s:
            raise ProtocolError(f"fold {block}: no telemetry was observed")
        idle = cannot_fire(here.select("channel", "value"), mine, "channel").where("cannot_fire")
        fold = {"fold": block, "samples": here.count(), "observed_s": observed.observed_s, "cannot_fire": sorted(r.channel for r in idle.collect()), "gaps": {}}
        for g in config.sensitivity_s:
            a = alarms.where((F.col("block") == block) & (F.col("gap_s") == g))
            fold["gaps"][g] = _measured(own_events.where(F.col("block") == block), a, here, start, end, observed.observed_s, config)
        if events_to is not None:
            headline = alarms.where((F.col("block") == block) & (F.col("gap_s") == config.max_gap_s))
            write_lines(arbiter.as_events(headline).orderBy("t_start", "id"), f"{events_to}/events-{block}", "overwrite")
        out.folds.append(fold | fold["gaps"][config.max_gap_s])
    table = spark.createDataFrame([tuple(None if f[m] is None else float(f[m]) for m in MEASURES) for f in out.folds], ", ".join(f"{m} double" for m in MEASURES))
    out.summary = [r.asDict() for r in metrics.summary(table, MEASURES).collect()]
    # One job scores every fold under every gap, so its CPU time is shared out over all that they observed.
    watched = sum(f["observed_s"] for f in out.folds) * len(config.sensitivity_s)
    out.timing["millicores_per_channel"] = 1000 * out.timing["cpu_s"] / watched / len(counts) * len(rows) if counts else None
    out.official = official_split(samples, found, channels, config)
    alarms.unpersist()
    return out


def repeated(spark: SparkSession, found: DataFrame, least_s: float) -> dict:
    """Run a plan until its tasks' CPU time adds up to ``least_s``: passes, mean CPU seconds, rows. Passes that differ are refused."""
    digest = found.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*found.columns)).alias("x"))
    passes, seen = [], None
    while not passes or sum(passes) < least_s:
        last = _tasks_cpu(spark, -1)[1]
        result = digest.first()
        passes.append(_tasks_cpu(spark, last)[0] / 1e9)
        if seen is not None and result != seen:
            raise ProtocolError("two passes over the same samples gave different alarms")
        seen = result
        if not passes[-1]:  # the platform counts no CPU time
            break
    return {"alarms": seen["n"], "passes": len(passes), "cpu_s": sum(passes) / len(passes)}


def _tasks_cpu(spark: SparkSession, after: int) -> tuple[int, int]:
    """(CPU nanoseconds of all tasks in stages numbered above ``after``, the highest number)."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    rows = [(s.stageId(), s.executorCpuTime()) for s in (stages.apply(k) for k in range(stages.size()))]
    return sum(ns for k, ns in rows if k > after), max((k for k, _ in rows), default=-1)


def _refuse(troubles: DataFrame) -> None:
    """troubles(block, why): any row stops the evaluation; the first ten are named."""
    if found := troubles.orderBy("block", "why").limit(10).collect():
        raise ProtocolError("folds that would mislead: " + "; ".join(f"{r.block}: {r.why}" for r in found))


def _measured(events: DataFrame, alarms: DataFrame, samples: DataFrame, start: int, end: int, observed_s: float, config: EvalConfig) -> dict:
    """Metrics of one fold and gap. The range is the block, whose end is open: its last instant is the last microsecond before."""
    wise = metrics.event_wise(events, alarms, start, end, config.beta).first().asDict()
    each = metrics.timing(events, alarms, end, config.exponent)
    timing = metrics.timing_summary(each).first()
    aware = metrics.channel_aware(events, alarms, samples.select("channel").distinct(), end, config.beta).agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"), F.avg("f").alias("f")).first()
    delays = metrics.distribution(metrics.alarm_delays(events, alarms), "delay_s").first()
    firing = metrics.distribution(alarms, "delay_s").first()
    n = alarms.count()
    return wise | {
        "alarms": n,
        "alarms_per_day": n * 86400 / observed_s,
        "adtqc": timing.score,
        "adtqc_before": timing.before,
        "adtqc_after": timing.after,
        "channel_precision": aware.p,
        "channel_recall": aware.r,
        "channel_f": aware.f,
        "alarm_delay_n": delays.n,
        "alarm_delay_median_s": delays.median,
        "alarm_delay_p90_s": delays.p90,
        "firing_delay_median_s": firing.median,
    }


def official_split(samples: DataFrame, segments: DataFrame, channels: DataFrame, config: EvalConfig) -> dict:
    """Fit on the split's nominal training segments, score the whole archive, classify the other segments."""
    nominal = samples.where("train and not anomaly").select("channel", "value")
    own = derived(channels.select("channel", "kind"), nominal, config.margin, config.policy(), "channel")
    scores = detect.scored(samples, own).cache()
    alarms = arbiter.alarms(scores, config.medium, config.high)
    test = segments.where("not train")
    best = samples.join(scores.select("channel", "ts_us", "score"), ["channel", "ts_us"], "left").groupBy("segment").agg(F.max("score").alias("score"), F.count_if(F.col("score").isNull()).alias("bare"))
    far = samples.agg(F.max("ts_us")).first()[0]
    spans = alarms.select("channel", F.col("t_start_us").alias("a2"), F.coalesce("t_end_us", F.lit(far)).alias("b2"))
    hit = intervals.overlaps(test.select("segment", "channel", F.col("start_us").alias("a"), F.col("end_us").alias("b")), spans, 6 * 3600 * SECOND, "channel").select("segment").distinct().withColumn("flagged", F.lit(True))
    rows = test.join(best, "segment").join(hit, "segment", "left").select(F.col("anomaly").alias("label"), F.coalesce("flagged", F.lit(False)).alias("flagged"), "score", "bare").cache()
    if rows.where("bare > 0").limit(1).count():
        raise ProtocolError("samples of a test segment have no score")
    n = rows.agg(F.count("*").alias("segments"), F.count_if("label").alias("anomalous")).first().asDict()
    out = n | metrics.confusion(rows).first().asDict()
    if 0 < n["anomalous"] < n["segments"]:
        curve = metrics.curve(rows)
        out |= {"roc_auc": metrics.roc_auc(curve).first()[0], "average_precision": metrics.average_precision(curve).first()[0]}
    scores.unpersist()
    rows.unpersist()
    return out


def shown(x: object) -> str:
    """Undefined is n/a, never 0."""
    return "n/a" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)


def markdown(e: Evaluation) -> str:
    lines = ["# Walk-forward evaluation", "", f"Embargo: {e.lookback_s:g} s lookback + {e.longest_event_s:g} s longest event.", "", "| measure | folds | mean | lowest | highest |", "|---|---|---|---|---|"]
    lines += [f"| {s['measure']} | {s['n']} | {shown(s['mean'])} | {shown(s['min'])} | {shown(s['max'])} |" for s in sorted(e.summary, key=lambda s: MEASURES.index(s["measure"]))]
    for f in e.folds:
        lines += ["", f"## Fold {f['fold']}", "", f"{f['alarms']} alarms, {f['tp']} of {f['tp'] + f['fn']} events, {f['fp']} false, {f['redundant']} redundant. Cannot fire: {', '.join(f['cannot_fire']) or 'none'}.", ""]
        lines += [f"- max gap {g:g} s: {m['alarms']} alarms, recall {shown(m['recall'])}, precision {shown(m['precision'])}, alarming precision {shown(m['alarming_precision'])}" for g, m in f["gaps"].items()]
    if e.timing:
        lines += ["", "## Cost", ""] + [f"- {k}: {shown(v)}" for k, v in e.timing.items()]
    lines += ["", "## Official split", ""] + [f"- {k}: {shown(v)}" for k, v in e.official.items()]
    return "\n".join(lines) + "\n"


def write(e: Evaluation, folder: str | Path, header: dict) -> None:
    """report.md, report.json and a limits file a fold; a stale report goes first."""
    folder = Path(folder)
    for name in ("report.md", "report.json"):
        (folder / name).unlink(missing_ok=True)
    for block, config in e.limits.items():
        write_atomic(folder / f"limits-{block}.yaml", limits_yaml(config))
    body = {"header": header | {"limits_sha256": {k: config_hash(v) for k, v in e.limits.items()}}, "folds": e.folds, "summary": e.summary, "official": e.official, "cost": e.timing, "provenance": {k: v["provenance"] for k, v in e.limits.items()}, "lookback_s": e.lookback_s, "longest_event_s": e.longest_event_s}
    write_atomic(folder / "report.json", json.dumps(body, indent=1, sort_keys=True, default=str) + "\n")
    write_atomic(folder / "report.md", markdown(e))
