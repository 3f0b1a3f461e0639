"""The live path: for each (mission, channel) and micro-batch, the batch windows over arrays, with what went before as their first row.

The terms are those of ``operators.detect``: a row that is ``broken`` off by silence begins a segment, a run of violations is what stands
between rows that don't violate, a cut (broken or clear) begins an epoch, and an epoch's first run to persist holds the latch from there.
What a key keeps is what the windows' frames would still reach: the last row, the run at the end, the latch, the open event.

Samples that don't move the channel forward are dropped (first arrival wins), so resent input changes nothing. There is no watermark:
lateness is a matter of each channel alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions.grades import QUALITIES, SEVERITIES

RECORD_SCHEMA = "mission string, channel string, kind string, at_us long, t_start_us long, t_end_us long, fired_at_us long, peak double, severity string, quality string"
STATE_SCHEMA = "seen_us long, ts_us long, value double, quality int, run_us long, run_n long, onset_us long, fired_at_us long, peak double, worst int, band int"
COLUMNS = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]


class Refused(ValueError):
    """A sample that the limits don't speak of."""


@dataclass(frozen=True)
class Kept:
    """State of a channel. None: there is none yet."""

    seen_us: int | None = None
    ts_us: int | None = None
    value: float | None = None
    quality: int | None = None
    run_us: int | None = None
    run_n: int | None = None
    onset_us: int | None = None
    fired_at_us: int | None = None
    peak: float | None = None
    worst: int | None = None
    band: int | None = None


def fresh(ts: np.ndarray, seen_us: int | None) -> np.ndarray:
    """Which rows, in order of arrival, move the channel forward."""
    top = np.maximum.accumulate(np.concatenate([[np.iinfo(np.int64).min if seen_us is None else seen_us], ts]))
    return ts > top[:-1]


@dataclass(frozen=True)
class Rules:
    """A row of the limits table and the severity bands, applied to arrays."""

    rule: dict
    medium: float
    high: float

    def measured(self, v: np.ndarray, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, clear) of each row; ``rate`` is NaN where there is none, or where none is limited."""
        r = self.rule
        if r["check"] == "states":
            known = np.isin(v, r["allowed"])
            return (~known).astype(float), known
        width = r["high"] - r["low"]
        pad = r["hysteresis"] * width
        score = np.maximum(0.0, np.maximum(r["low"] - v, v - r["high"]) / width)
        clear = (v >= r["low"] + pad) & (v <= r["high"] - pad)
        if r["max_rate"] is not None:
            score = np.fmax(score, (rate - r["max_rate"]) / r["max_rate"])
            clear &= ~(rate > r["max_rate"] * (1 - r["hysteresis"]))
        return score, clear & ~(score > 0)

    def onsets(self, at: Kept, ts: np.ndarray, broken: np.ndarray, violating: np.ndarray, clear: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run start, length of the run so far, onset) of each row; -1 where there is none."""
        place = np.arange(len(ts))
        before = np.concatenate([[at.run_us is not None], violating[:-1]])
        begun = np.maximum.accumulate(np.where(violating & (broken | ~before), place, -1))
        carried = begun < 0  # the run that was going on before the batch
        start = np.where(violating, np.where(carried, at.run_us if at.run_us is not None else -1, ts[begun]), -1)
        n = np.where(violating, np.where(carried, (at.run_n or 0) + place, place - begun) + 1, 0)
        r = self.rule
        lasted = violating & ((n >= r["persist_n"]) if r["persist_n"] is not None else ((ts - start) / 1e6 >= r["persist_s"]))
        epoch = np.cumsum(broken | clear)
        onset = np.full(len(ts), -1, np.int64)
        which, first = np.unique(epoch[lasted], return_index=True)
        first = np.flatnonzero(lasted)[first]
        found = np.searchsorted(which, epoch)
        held = (found < len(which)) & (which[np.minimum(found, len(which) - 1)] == epoch) if len(which) else np.zeros(len(ts), bool)
        if held.any():
            by = first[found[held]]
            onset[held] = np.where(place[held] >= by, start[by], -1)
        if at.onset_us is not None:
            onset[epoch == 0] = at.onset_us
        return start, n, onset

    def applied(self, at: Kept, ts: np.ndarray, v: np.ndarray, quality: np.ndarray) -> tuple[Kept, list[tuple]]:
        """Fresh samples in order -> what is kept, and the records (kind, at, start, end, fired, peak, severity, quality)."""
        if len(ts):
            at = replace(at, seen_us=int(ts[-1]))
        usable = np.isfinite(v) & (self.rule["check"] != "none")
        ts, v, quality = ts[usable], v[usable], quality[usable]
        if not len(ts):
            return at, []
        gap = np.diff(np.concatenate([[ts[0] if at.ts_us is None else at.ts_us], ts]))
        broken = gap > self.rule["max_gap_s"] * 1e6
        step = np.abs(np.diff(np.concatenate([[np.nan if at.value is None else at.value], v])))
        known = ~broken & (gap > 0) & (self.rule["max_rate"] is not None)
        rate = np.where(known, step / np.maximum(gap, 1) * 1e6, np.nan)
        score, clear = self.measured(v, rate)
        previous = np.concatenate([[at.quality if at.quality is not None else 0], quality[:-1]])
        worst = np.where(np.isnan(rate) | (self.rule["check"] == "states"), quality, np.maximum(quality, previous))
        start, n, onset = self.onsets(at, ts, broken, score > 0, clear)
        going = start[-1] >= 0
        after = replace(at, ts_us=int(ts[-1]), value=float(v[-1]), quality=int(quality[-1]), run_us=int(start[-1]) if going else None, run_n=int(n[-1]) if going else None, onset_us=int(onset[-1]) if onset[-1] >= 0 else None)
        return self._published(at, after, ts, score, worst, onset)

    def _published(self, at: Kept, after: Kept, ts: np.ndarray, score: np.ndarray, worst: np.ndarray, onset: np.ndarray) -> tuple[Kept, list[tuple]]:
        """Records of each stretch of rows with one onset, the open event's stretch first."""
        out: list[tuple] = []
        edges = [0, *(np.flatnonzero(np.diff(onset)) + 1).tolist(), len(ts)]
        if at.onset_us is not None and onset[0] != at.onset_us:
            out.append(("close", int(ts[0]), at.onset_us, at.ts_us, at.fired_at_us, at.peak, SEVERITIES[at.band], QUALITIES[at.worst]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if onset[a] < 0:
                continue
            goes_on = a == 0 and at.onset_us == onset[0]
            fired, peak, bad, band = (at.fired_at_us, at.peak, at.worst, at.band) if goes_on else (int(ts[a]), -np.inf, 0, -1)
            peaks, bads = np.maximum(np.maximum.accumulate(score[a:b]), peak), np.maximum(np.maximum.accumulate(worst[a:b]), bad)
            bands = np.searchsorted([self.medium, self.high], peaks, "right")
            record = lambda kind, k, when, end: (kind, when, int(onset[a]), end, fired, float(peaks[k]), SEVERITIES[bands[k]], QUALITIES[bads[k]])  # noqa: B023, E731
            for k in np.flatnonzero(np.diff(np.concatenate([[band], bands]))).tolist():
                out.append(record("rise" if k or goes_on else "open", k, int(ts[a + k]), None))
            if b < len(ts):
                out.append(record("close", b - a - 1, int(ts[b]), int(ts[b - 1])))
            else:
                after = replace(after, fired_at_us=fired, peak=float(peaks[-1]), worst=int(bads[-1]), band=int(bands[-1]))
        return after if after.onset_us is not None else replace(after, fired_at_us=None, peak=None, worst=None, band=None), out


class Channel:
    """One channel fed by hand: ``feed`` gives the records that a sample causes, ``finish`` those of the stream's end."""

    def __init__(self, rule: dict, medium: float, high: float):
        self.rules, self.kept = Rules(rule, medium, high), Kept()

    def feed(self, ts: int, value: float, quality: str) -> Iterator[tuple]:
        at = np.array([ts])
        if fresh(at, self.kept.seen_us)[0]:
            self.kept, out = self.rules.applied(self.kept, at, np.array([np.nan if value is None else value], float), np.array([QUALITIES.index(quality)]))
            yield from out

    @property
    def onset_us(self) -> int | None:
        return self.kept.onset_us

    def finish(self) -> Iterator[tuple]:
        k = self.kept
        if k.onset_us is not None:
            yield "finish", None, k.onset_us, None, k.fired_at_us, k.peak, SEVERITIES[k.band], QUALITIES[k.worst]


class Processor(StatefulProcessor):
    def __init__(self, rules: dict[str, dict], medium: float, high: float, mission: str | None):
        self.rules, self.medium, self.high, self.mission = rules, medium, high, mission

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("channel", STATE_SCHEMA)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        mission, name = key
        if name not in self.rules:
            raise Refused(f"channel {name} has no entry in the limits")
        if self.mission is not None and mission != self.mission:
            raise Refused(f"a sample of mission {mission} met the limits of {self.mission}")
        at = Kept(*self.held.get()) if self.held.exists() else Kept()
        batch = pd.concat(list(rows))
        # Rows of a key come unordered within a batch.
        batch = batch.sort_values("arrival" if "arrival" in batch.columns else "ts_us", kind="stable")
        ts = batch["ts_us"].to_numpy(np.int64)
        new = fresh(ts, at.seen_us)
        quality = batch["quality"].map(QUALITIES.index).to_numpy(np.int64)
        after, out = Rules(self.rules[name], self.medium, self.high).applied(at, ts[new], batch["value"].to_numpy(float)[new], quality[new])
        self.held.update(astuple(after))
        yield pd.DataFrame([(mission, name, *r) for r in out], columns=COLUMNS).astype({"at_us": "Int64", "t_start_us": "Int64", "t_end_us": "Int64", "fired_at_us": "Int64"})

    def close(self) -> None:
        pass


def detected(stream: DataFrame, limits: DataFrame, medium: float, high: float, mission: str | None = None) -> DataFrame:
    """stream(mission, channel, ts_us, value, quality[, arrival]) -> records. ``limits`` has a row a channel and goes with the processor.

    ``arrival``, where there is such a column, orders a batch's rows; else time does. A channel without an entry in the limits stops
    the query, and so does a sample of another mission if ``mission`` is given.
    """
    rules = {r["channel"]: r.asDict() for r in limits.collect()}
    return stream.groupBy("mission", "channel").transformWithStateInPandas(Processor(rules, medium, high, mission), RECORD_SCHEMA, "Append", "None")


def still_open(spark: SparkSession, checkpoint: str) -> DataFrame:
    """At the end of a stream: events whose latch holds, from the state in the checkpoint."""
    state = spark.read.format("statestore").option("stateVarName", "channel").load(checkpoint)
    rows = state.select("key.*", "value.*").where("onset_us is not null")
    name = lambda c, names: F.element_at(F.array(*[F.lit(x) for x in names]), F.col(c) + 1)
    none = F.lit(None).cast("long")
    return rows.select("mission", "channel", F.lit("finish").alias("kind"), none.alias("at_us"), F.col("onset_us").alias("t_start_us"), none.alias("t_end_us"), "fired_at_us", "peak", name("band", SEVERITIES).alias("severity"), name("worst", QUALITIES).alias("quality"))


def feed_files(samples: DataFrame, folder: str, parts: int) -> None:
    """Write samples as files of consecutive stretches of time, in the order that a stream over the folder takes them.

    The samples are dealt out once, by range of time, and each stretch is then appended from that table."""
    bounds = samples.selectExpr("min(ts_us) as lo", "max(ts_us) as hi").first()
    step = max(1, -(-(bounds["hi"] - bounds["lo"] + 1) // parts))
    stretch = F.floor((F.col("ts_us") - bounds["lo"]) / step)
    dealt = samples.withColumn("stretch", stretch).repartition(parts, "stretch").sortWithinPartitions("stretch", "ts_us").persist()
    for k in range(parts):
        dealt.where(F.col("stretch") == k).drop("stretch").coalesce(1).write.mode("append").parquet(folder)
    dealt.unpersist()
