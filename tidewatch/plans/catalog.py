"""The registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import intervals
from tidewatch.functions.instants import SECOND, nanos
from tidewatch.operators import arbiter, baseline, checks, detect, limits, metrics, replay, truth
from tidewatch.plans import sql as q
from tidewatch.plans import tables as t
from tidewatch.sources import records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r6(c) -> object:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def r6_binary(name: str) -> object:
    """Six places of a number >= 0 as the SQL's round takes them, from the binary product with 10^6; Spark's takes them from the decimal digits, which
    differs at halves (a rate at a regular distance of 32 s is one every other time)."""
    x, scaled = F.col(name), F.col(name) * 1e6
    whole = F.rint(scaled)  # halves to even
    # NaN, above infinity here, and what has an infinite product stay as they are.
    return F.when(scaled < float("inf"), F.when(scaled - whole == 0.5, whole + 1).otherwise(whole) / 1e6).otherwise(x)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def main_scores(spark: SparkSession, d: str) -> DataFrame:
    s = t.readings(spark, d)
    return detect.scored(t.tested(s), t.limits(s).drop("policy"))


def main_alarms(spark: SparkSession, d: str) -> DataFrame:
    """A row an alarm, kept, as the metrics read it on several branches of one plan."""
    return arbiter.alarms(main_scores(spark, d), t.MEDIUM, t.HIGH).persist()


def with_runs(spark: SparkSession, d: str) -> DataFrame:
    return truth.runs(truth.segments(t.labelled(spark, d)), t.PERIODS)


def all_events(spark: SparkSession, d: str) -> DataFrame:
    """A row a labelled event, kept for the same reason."""
    return truth.labelled_events(with_runs(spark, d)).persist()


def judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    end = t.readings(spark, d).agg(F.max("ts_us")).first()[0]
    return all_events(spark, d).where(F.col("start_us") >= t.TEST_US), main_alarms(spark, d), end


# --- readings and replay ---------------------------------------------------------------------------------------------------------------


@registered(q.query(f"select mission, channel, ts_us, value from t where ts_us >= {t.TEST_US} and ts_us < {t.MIDDLE_US}", q.READINGS))
def readings_window(spark, d):
    return replay.window(t.readings(spark, d), t.TEST_US, t.MIDDLE_US).select("mission", "channel", "ts_us", "value")


@registered(q.query("select channel, count(*) as n, min(ts_us) as first_us from t group by channel", q.READINGS))
def channel_list(spark, d):
    return t.readings(spark, d).groupBy("channel").agg(F.count("*").alias("n"), F.min("ts_us").alias("first_us"))


RANKS = "select {0} as seed, channel, (row_number() over (order by sha256('{0}/' || channel)) - 1)::bigint as rank from (select distinct channel from t)"


@registered(q.query(RANKS.format(0) + " union all " + RANKS.format(7), q.READINGS))
def channel_rank(spark, d):
    r = t.readings(spark, d)
    parts = [replay.channel_ranks(r, s).select(F.lit(s).alias("seed"), "channel", "rank") for s in (0, 7)]
    return parts[0].unionByName(parts[1])


@registered(
    q.query(
        "select 'undeclared' as kind, channel from (select distinct channel from t) where channel not in (select channel from d) union all select 'missing', channel from d where channel not in (select channel from t)",
        q.READINGS,
        "d as (select * from (values ('click'), ('view'), ('heartbeat')) v(channel))",
    )
)
def declared_vs_found(spark, d):
    declared = spark.createDataFrame([("click",), ("view",), ("heartbeat",)], "channel string")
    found = t.readings(spark, d).select("channel").distinct()
    return found.join(declared, "channel", "left_anti").select(F.lit("undeclared").alias("kind"), "channel").unionByName(declared.join(found, "channel", "left_anti").select(F.lit("missing").alias("kind"), "channel"))


@registered("select event_id, epoch_us(ts) * 1000 as ts_ns from events")
def utc_epoch_ns(spark, d):
    from tidewatch.functions.instants import micros

    return t.table(spark, d, "events").select("event_id", nanos(micros(F.col("ts"))).alias("ts_ns"))


@registered(q.query(f"select channel, ts_us, value, 1800000000000000 + floor((ts_us - {t.TEST_US}) / 1000.0::double)::bigint as wall_us from t where ts_us >= {t.TEST_US}", q.READINGS))
def publish_walltime(spark, d):
    r = replay.window(t.readings(spark, d), t.TEST_US, None)
    return replay.published(r, t.TEST_US, 1000.0, 1800000000000000).select("channel", "ts_us", "value", "wall_us")


@registered(q.query("select channel, ts_us, row_number() over (order by ts_us, rank) as place from t join k using (channel)", q.READINGS, "k as (select channel, row_number() over (order by sha256('0/' || channel)) - 1 as rank from (select distinct channel from t))"))
def stream_order(spark, d):
    stream = replay.offline(t.readings(spark, d)).join(replay.channel_ranks(t.readings(spark, d), 0), "channel")
    return replay.placed(stream).select("channel", "ts_us", "place")


@registered(q.query("select place, channel, ts_us from (select channel, ts_us, row_number() over w as place, lead(ts_us) over w - ts_us as wait, lead(ts_us) over w as next_us from t join k using (channel) window w as (order by ts_us, rank)) where next_us is not null and (place % 500 = 0 or wait > 900000000)", q.READINGS, "k as (select channel, row_number() over (order by sha256('0/' || channel)) - 1 as rank from (select distinct channel from t))"))
def checkpoint_history(spark, d):
    stream = replay.offline(t.readings(spark, d)).join(replay.channel_ranks(t.readings(spark, d), 0), "channel")
    return replay.checkpoints(replay.placed(stream), 500, 900 * SECOND).select("place", "channel", "ts_us")


@registered(q.query(f"select channel, ts_us, rank from t join k using (channel) where ts_us > {t.MIDDLE_US} or (ts_us = {t.MIDDLE_US} and rank > 2)", q.READINGS, "k as (select channel, (row_number() over (order by sha256('0/' || channel)) - 1)::bigint as rank from (select distinct channel from t))"))
def resume_after(spark, d):
    stream = t.readings(spark, d).join(replay.channel_ranks(t.readings(spark, d), 0), "channel")
    return replay.after(stream, t.MIDDLE_US, 2).select("channel", "ts_us", "rank")


@registered("select o_orderkey, coalesce(epoch_us(o_orderdate) > max(epoch_us(o_orderdate)) over (partition by o_orderpriority order by o_orderkey rows between unbounded preceding and 1 preceding), true) as fresh from orders")
def repeats_dropped(spark, d):
    from tidewatch.functions.instants import micros

    o = t.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", micros(F.col("o_orderdate")).alias("ts_us"))
    return detect.fresh(o, "o_orderkey", "o_orderpriority").select("o_orderkey", "fresh")


# --- limits ------------------------------------------------------------------------------------------------------------------------------


@registered(q.query(f"select channel, {q.R6('low')} as low, {q.R6('high')} as high from b", q.READINGS, q.BOUNDS))
def nominal_envelope(spark, d):
    return rounded(t.bounds(t.readings(spark, d)), "low", "high")


@registered(
    q.query(
        f"select channel, kind, case when kind = 'telecommand' or n is null then 'none' when kind = 'categorical' then 'states' when hi <= lo then 'none' else 'limits' end as chk, case when kind = 'numeric' and hi > lo then {q.R6(f'lo - {t.MARGIN}::double * (hi - lo)')} end as low, case when kind = 'numeric' and hi > lo then {q.R6(f'hi + {t.MARGIN}::double * (hi - lo)')} end as high from ch left join st using (channel)",
        q.READINGS,
        "ch as (select * from (values ('click', 'numeric'), ('error', 'telecommand'), ('heartbeat', 'numeric'), ('purchase', 'categorical'), ('view', 'numeric')) v(channel, kind))",
        f"st as (select channel, min(value) as lo, max(value) as hi, count(*) as n from t where ts_us < {t.TEST_US} and value <= {t.NOMINAL_MAX} group by channel)",
    )
)
def derived_limits(spark, d):
    channels = spark.createDataFrame([("click", "numeric"), ("error", "telecommand"), ("heartbeat", "numeric"), ("purchase", "categorical"), ("view", "numeric")], "channel string, kind string")
    values = t.training(t.readings(spark, d)).where(F.col("value") <= t.NOMINAL_MAX).select("channel", "value")
    out = limits.derived(channels, values, t.MARGIN, t.POLICIES[t.MAIN], "channel").join(channels, "channel")
    return rounded(out.select("channel", "kind", F.col("check").alias("chk"), "low", "high"), "low", "high")


@registered(q.query(f"select channel, value from c where ts_us < {t.TEST_US} group by channel, value", q.CODES))
def allowed_states(spark, d):
    codes = t.training(t.codes(spark, d))
    channels = codes.select("channel", "kind").distinct()
    return limits.derived(channels, codes.select("channel", "value"), t.MARGIN, t.POLICIES[t.MAIN], "channel").select("channel", F.explode("allowed").alias("value"))


@registered(q.query(f"select channel, count(ts_us) as n from ch left join (select channel, ts_us from t where ts_us < {t.TEST_US} and value <= {t.NOMINAL_MAX}) using (channel) group by channel", q.READINGS, "ch as (select distinct channel from t union select 'heartbeat')"))
def nominal_counts(spark, d):
    r = t.readings(spark, d)
    channels = r.select("channel").distinct().unionByName(spark.createDataFrame([("heartbeat",)], "channel string"))
    return limits.nominal_counts(channels, t.training(r).where(F.col("value") <= t.NOMINAL_MAX), "channel")


@registered(q.query(f"select channel, {q.R6('b.low')} as low, {q.R6('b.high')} as high, b.low <= lo and hi <= b.high as cannot_fire from b join (select channel, min(value) as lo, max(value) as hi from t where ts_us >= {t.TEST_US} group by channel) using (channel)", q.READINGS, q.BOUNDS))
def cannot_fire(spark, d):
    s = t.readings(spark, d)
    own = t.limits(s).drop("policy")
    return rounded(limits.cannot_fire(t.tested(s), own, "channel").join(own, "channel").select("channel", "low", "high", "cannot_fire"), "low", "high")


# --- detection ----------------------------------------------------------------------------------------------------------------------------

GAP = 7200 * SECOND
SEGMENTS_SQL = f"g0 as (select *, case when ts_us - lag(ts_us) over (partition by channel order by ts_us) > {GAP} then 1 else 0 end as silent from t), g as (select *, sum(silent) over (partition by channel order by ts_us rows unbounded preceding)::bigint as seg from g0)"


@registered(q.query("select channel, ts_us, seg from g", q.READINGS, SEGMENTS_SQL))
def gap_segments(spark, d):
    return detect.segmented(t.readings(spark, d), F.lit(GAP), "mission", "channel").select("channel", "ts_us", "seg")


@registered(q.query(f"select channel, ts_us, {q.R6('abs(value - lag(value) over w) / ((ts_us - lag(ts_us) over w) / 1e6::double)')} as rate from g window w as (partition by channel, seg order by ts_us)", q.READINGS, SEGMENTS_SQL))
def rate_of_change(spark, d):
    """Readings of one instant go by event_id, the order of the table, as the SQL's ORDER BY leaves them open."""
    rows = detect.segmented(t.readings(spark, d, "event_id"), F.lit(GAP), "mission", "channel", ties=("event_id",))
    rows = detect.rated(rows, "mission", "channel", ties=("event_id",))
    return rows.select("channel", "ts_us", r6_binary("rate").alias("rate"))


@registered(q.query(f"select channel, ts_us, {q.R6('greatest(low - value, value - high, 0) / (high - low)')} as score from t join b using (channel) where ts_us >= {t.TEST_US} and isfinite(value)", q.READINGS, q.BOUNDS))
def limit_scores(spark, d):
    return main_scores(spark, d).select("channel", "ts_us", r6("score").alias("score"))


@registered(q.query(f"select channel, ts_us, case when value in (select value from c c2 where c2.channel = c.channel and ts_us < {t.TEST_US} and value < 90) then 0.0 else 1.0 end::double as score from c where ts_us >= {t.TEST_US} and value is not null", q.CODES))
def state_scores(spark, d):
    codes = t.codes(spark, d)
    own = limits.derived(codes.select("channel", "kind").distinct(), t.training(codes).where("value < 90").select("channel", "value"), t.MARGIN, t.POLICIES[t.MAIN], "channel")
    return detect.scored(t.tested(codes), own).select("channel", "ts_us", "score")


VIOLATION_RUNS = f"""v0 as (select channel, ts_us, (value < low or value > high) as bad, case when ts_us - lag(ts_us) over (partition by channel order by ts_us) > {GAP} then 1 else 0 end as silent from t join b using (channel) where ts_us >= {t.TEST_US} and isfinite(value)),
v1 as (select *, sum(silent) over (partition by channel order by ts_us rows unbounded preceding) as seg from v0),
v2 as (select *, sum(case when bad then 0 else 1 end) over (partition by channel, seg order by ts_us rows unbounded preceding) as island from v1)"""


@registered(q.query("select channel, min(ts_us) as start_us, max(ts_us) as end_us, count(*) as n from v2 where bad group by channel, seg, island", q.READINGS, q.BOUNDS, VIOLATION_RUNS))
def violation_runs(spark, d):
    rows = main_scores(spark, d).where("violating")
    return rows.groupBy("channel", "run_start_us").agg(F.max("ts_us").alias("end_us"), F.max("run_n").alias("n")).select("channel", F.col("run_start_us").alias("start_us"), "end_us", "n")


ALL = tuple(t.POLICIES)


@registered(q.query("select policy, channel, ts_us, onset_us is not null as firing, onset_us from s", q.READINGS, q.BOUNDS, q.latch(*ALL)))
def alarm_latch(spark, d):
    s = t.readings(spark, d)
    rows = detect.scored(t.tested(s), t.limits(s, *ALL), by=("policy", "mission", "channel"))
    return rows.select("policy", "channel", "ts_us", "firing", "onset_us")


@registered(q.query(f"select id, channel, t_start_us, t_end_us, fired_at_us, {q.R6('(fired_at_us - t_start_us) / 1e6::double')} as delay_s, {q.R6('peak')} as peak, severity, n_firing from a", *q.BASE))
def alarms(spark, d):
    return rounded(main_alarms(spark, d), "peak", "delay_s").select("id", "channel", "t_start_us", "t_end_us", "fired_at_us", "delay_s", "peak", "severity", "n_firing")


RECORDS = f"""f0 as (select channel, ts_us, score, onset_us, lead(ts_us) over (partition by channel order by ts_us) as next_us, lead(onset_us) over (partition by channel order by ts_us) as next_onset from s),
f1 as (select *, max(score) over (partition by channel, onset_us order by ts_us rows unbounded preceding) as peak from f0 where onset_us is not null),
f2 as (select *, case when peak >= {t.HIGH} then 'high' when peak >= {t.MEDIUM} then 'medium' else 'low' end as severity from f1),
f3 as (select *, lag(severity) over (partition by channel, onset_us order by ts_us) as before from f2)"""


@registered(
    q.query(
        f"""select channel, onset_us as t_start_us, kind, at_us, t_end_us, severity, {q.R6('peak')} as peak from (
 select channel, onset_us, 'open' as kind, ts_us as at_us, null::bigint as t_end_us, severity, peak from f3 where before is null
 union all select channel, onset_us, 'rise', ts_us, null, severity, peak from f3 where before <> severity
 union all select channel, onset_us, 'finish', null, null, severity, peak from f3 where next_us is null
 union all select channel, onset_us, 'close', next_us, ts_us, severity, peak from f3 where next_us is not null and next_onset is distinct from onset_us)""",
        q.READINGS,
        q.BOUNDS,
        q.latch(),
        RECORDS,
    )
)
def alarm_records(spark, d):
    out = arbiter.records(main_scores(spark, d), t.MEDIUM, t.HIGH)
    return rounded(out.select("channel", "t_start_us", "kind", "at_us", "t_end_us", "severity", "peak"), "peak")


ADMITTED = f"""select channel, onset_us as t_start_us, kind, at_us, {q.R6('least(peak, 1.0)')} as peak from (
 select channel, onset_us, 'open' as kind, ts_us as at_us, severity, peak from f3 where before is null
 union all select channel, onset_us, 'rise', ts_us, severity, peak from f3 where before <> severity
 union all select channel, onset_us, 'finish', null, severity, peak from f3 where next_us is null
 union all select channel, onset_us, 'close', next_us, severity, peak from f3 where next_us is not null and next_onset is distinct from onset_us) where severity <> 'low'"""


@registered(q.query(ADMITTED, q.READINGS, q.BOUNDS, q.latch(), RECORDS))
def admitted_records(spark, d):
    """A hook that drops records of low severity and caps the peak."""
    hook = lambda r: r.where("severity <> 'low'").withColumn("peak", F.least("peak", F.lit(1.0)))
    out = arbiter.admitted(arbiter.records(main_scores(spark, d), t.MEDIUM, t.HIGH), hook)
    return rounded(out.select("channel", "t_start_us", "kind", "at_us", "peak"), "peak")


DETECTOR_BANDS = {n: (t.MEDIUM * (k + 1), t.HIGH * (k + 1)) for k, n in enumerate(ALL)}
_BAND = lambda side: "case policy " + " ".join(f"when '{n}' then {v[side]}::double" for n, v in DETECTOR_BANDS.items()) + " end"


@registered(q.query(f"select policy as detector, 'events:' || policy || id[17:] as id, t_end_us, {q.R6('peak')} as peak, case when peak >= {_BAND(1)} then 'high' when peak >= {_BAND(0)} then 'medium' else 'low' end as severity from a", q.READINGS, q.BOUNDS, q.latch(*ALL), q.ALARMS))
def alarms_by_detector(spark, d):
    """Every policy as a detector with severity bands of its own."""
    s = t.readings(spark, d)
    rows = detect.scored(t.tested(s), t.limits(s, *ALL), by=("policy", "mission", "channel")).withColumnRenamed("policy", "detector")
    medium, high = arbiter.bands(DETECTOR_BANDS)
    found = arbiter.alarms(rows, medium, high, by=("detector", "mission", "channel"), detector=F.col("detector"))
    return rounded(found.select("detector", "id", "t_end_us", "peak", "severity"), "peak")


@registered(q.query("select policy, max(coalesce((n - 1) * gap_us / 1e6, s + gap_us / 1e6))::double as lookback_s from p group by policy", q.READINGS, q.BOUNDS, q.latch(*ALL)))
def detector_lookback(spark, d):
    return limits.lookback(t.limits(t.readings(spark, d), *ALL), "policy")


STEPS = f"""st0 as (select channel, ts_us, value > {t.NOMINAL_MAX} as flagged from t where ts_us >= {t.TEST_US}),
st1 as (select channel, ts_us, flagged from st0 union all select channel, {t.TEST_US}, arg_min(flagged, ts_us) from st0 group by channel having min(ts_us) > {t.TEST_US} union all select channel, {t.END_US}, arg_max(flagged, ts_us) from st0 group by channel having max(ts_us) < {t.END_US}),
st2 as (select *, lag(flagged) over w as was, lead(ts_us) over w as next_us from st1 window w as (partition by channel order by ts_us)),
st3 as (select *, sum(case when flagged is distinct from was then 1 else 0 end) over (partition by channel order by ts_us rows unbounded preceding) as run from st2)"""


@registered(q.query("select channel, min(ts_us) * 2000 as a, (case when count(next_us) < count(*) then max(ts_us) * 2000 else max(next_us) * 2000 - 1 end)::bigint as b from st3 where flagged group by channel, run", q.READINGS, STEPS))
def flagged_spans(spark, d):
    series = t.tested(t.readings(spark, d)).select("channel", "ts_us", (F.col("value") > t.NOMINAL_MAX).alias("flagged"))
    return truth.flagged_spans(series, t.TEST_US, t.END_US, "channel")


@registered(q.query("select 'scores' as what, 0::bigint as n union all select 'events', 0::bigint", q.READINGS))
def unsound(spark, d):
    """Scores and events that break what they must satisfy: none."""
    scores = main_scores(spark, d)
    events = arbiter.as_events(arbiter.alarms(scores, t.MEDIUM, t.HIGH))
    counts = [checks.unsound_scores(scores).select(F.lit("scores").alias("what")), checks.unsound_events(events).select(F.lit("events").alias("what"))]
    names = spark.createDataFrame([("scores",), ("events",)], "what string")
    return names.join(counts[0].unionByName(counts[1]).groupBy("what").agg(F.count("*").alias("n")), "what", "left").fillna(0, ["n"])


@registered(q.query("select mission || '/' || channel as key, count(*) as n from t group by all", q.READINGS))
def partition_keys(spark, d):
    return t.readings(spark, d).groupBy(records.partition_key().alias("key")).agg(F.count("*").alias("n"))


@registered(
    q.query(
        f"select channel, sum(samples)::bigint as samples, sum(repeats)::bigint as repeats, sum(scored)::bigint as scored, sum(firing)::bigint as firing, {q.R6('sum(scored) / sum(samples - repeats)::double')} as ratio from (select channel, count(*) + count(*) filter (ts_us // 1000000 % 5 = 0) as samples, count(*) + count(*) filter (ts_us // 1000000 % 5 = 0) - count(distinct ts_us) as repeats, count(*) filter (isfinite(value)) as scored from t where ts_us >= {t.TEST_US} group by channel) join (select channel, count(onset_us) as firing from s group by channel) using (channel) group by rollup (channel)",
        q.READINGS,
        q.BOUNDS,
        q.latch(),
    )
)
def coverage_by_channel(spark, d):
    """A fifth of the samples arrives a second time, after all others."""
    sent = t.tested(t.readings(spark, d)).select("mission", "channel", "ts_us")
    again = sent.where(F.floor(F.col("ts_us") / SECOND) % 5 == 0)
    arrived = sent.withColumn("arrival", F.col("ts_us")).unionByName(again.withColumn("arrival", F.col("ts_us") + 10**17))
    samples = detect.fresh(arrived, "arrival", "mission", "channel")
    return detect.coverage(samples, main_scores(spark, d), "channel").select("channel", "samples", "repeats", "scored", "firing", r6("ratio").alias("ratio"))


@registered(
    q.query(
        "select channel, ts_us, n, round(sum * 100)::bigint as hundredths, round(sd, 6) as sd, round(case when sd > 0 then abs(value - mean) / sd end, 4) as z from (select channel, ts_us, value, count(*) over w as n, sum(value) over w as sum, avg(value) over w as mean, stddev_samp(value) over w as sd from t where isfinite(value) window w as (partition by channel order by ts_us rows between 20 preceding and 1 preceding))",
        q.READINGS,
    )
)
def rolling_baseline(spark, d):
    rows = baseline.rolling(t.readings(spark, d), 20, "mission", "channel")
    # The mean as its exact sum in hundredths, as a mean of cents can end in a tie.
    return rows.select("channel", "ts_us", "n", F.round(F.col("mean") * F.col("n") * 100).cast("long").alias("hundredths"), r6("sd").alias("sd"), F.round("z", 4).alias("z"))


DAY_US = 86400 * SECOND


@registered(q.query(f"select channel, (ts_us // {DAY_US}) * {DAY_US} as start_us, count(*) as n, min(value) as low, max(value) as high, round(sum(value) * 100)::bigint as hundredths from t where isfinite(value) group by channel, ts_us // {DAY_US}", q.READINGS))
def rollup_daily(spark, d):
    hours = baseline.rollup(t.readings(spark, d), 3600 * SECOND, "channel")
    days = baseline.coarser(hours, DAY_US, "channel")
    return days.withColumn("hundredths", F.round(F.col("mean") * F.col("n") * 100).cast("long")).drop("mean")


# --- truth --------------------------------------------------------------------------------------------------------------------------------


@registered(q.query("select segment, channel, sampling_s, anomaly, train, start_us, end_us, samples from seg", q.READINGS, q.LABELLED))
def segments(spark, d):
    return truth.segments(t.labelled(spark, d)).select("segment", "channel", "sampling_s", "anomaly", "train", "start_us", "end_us", "samples")


@registered(q.query("select segment, count(distinct anomaly) > 1 as mixed from (select segment, value > 100 as anomaly from lab) group by segment", q.READINGS, q.LABELLED))
def segments_mixed(spark, d):
    rows = t.labelled(spark, d).withColumn("anomaly", F.col("value") > 100)
    return truth.segments(rows).select("segment", "mixed")


@registered(q.query("select channel, run, min(start_us) as start_us, max(end_us) as end_us, count(*) as segments from r group by channel, run", q.READINGS, q.LABELLED, q.RUNS))
def continuous_runs(spark, d):
    return truth.run_spans(with_runs(spark, d))


@registered(q.query("select id, channel, start_us, end_us, n from ev", q.READINGS, *q.TRUTH))
def labelled_events(spark, d):
    return all_events(spark, d).select("id", "channel", "start_us", "end_us", F.size("segments").cast("long").alias("n"))


OBSERVED = """rs as (select min(start_us) as start_us, max(end_us) as end_us from r group by channel, run),
o0 as (select block, greatest(start_us, block_start_us) as lo, least(end_us, block_end_us) as hi from rs join bl on start_us < block_end_us and end_us >= block_start_us),
o1 as (select *, case when lo > max(hi) over (partition by block order by lo, hi rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from o0),
o2 as (select block, max(hi) - min(lo) as us from (select *, sum(new) over (partition by block order by lo, hi rows unbounded preceding) as g from o1) group by block, g),
ob as (select block, sum(us) / 1e6::double as observed_s from o2 group by block)"""


@registered(q.query(f"select block, {q.R6('observed_s')} as observed_s from ob", q.READINGS, q.LABELLED, q.RUNS, q.BLOCKS, OBSERVED))
def observed_seconds(spark, d):
    return rounded(truth.observed_seconds(truth.run_spans(with_runs(spark, d)), t.blocks(spark)), "observed_s")


@registered(q.query("select block, id, start_us, end_us, boundary_us from (select block, unnest([block_start_us, block_end_us]) as boundary_us from bl) join ev on start_us < boundary_us and boundary_us <= end_us", q.READINGS, *q.TRUTH, q.BLOCKS))
def boundary_check(spark, d):
    return truth.straddling(all_events(spark, d), t.blocks(spark)).select("block", "id", "start_us", "end_us", "boundary_us")


@registered(q.query("select block, id, channel, start_us from ev join bl on start_us >= block_start_us and start_us < block_end_us", q.READINGS, *q.TRUTH, q.BLOCKS))
def block_events(spark, d):
    return truth.in_blocks(all_events(spark, d), t.blocks(spark)).select("block", "id", "channel", "start_us")


LOOKBACK = max(p.lookback_s() for p in t.POLICIES.values())


@registered(q.query(f"select block, {q.R6('e')} as embargo_s, block_start_us - (e * 1000000)::bigint as training_end_us, block_start_us, block_end_us from bl cross join (select {LOOKBACK} + max(end_us - start_us) / 1e6::double as e from ev)", q.READINGS, *q.TRUTH, q.BLOCKS))
def folds_embargo(spark, d):
    gap = truth.embargo(LOOKBACK, all_events(spark, d)).first()["embargo_s"] or 0.0
    return t.blocks(spark).select("block", r6(F.lit(gap)).alias("embargo_s"), (F.col("block_start_us") - round(gap * 1e6)).cast("long").alias("training_end_us"), "block_start_us", "block_end_us")


@registered(
    q.query(
        f"select block, (select count(*) from ev where start_us >= block_start_us and start_us < block_end_us) as events, (select count(*) from (select distinct channel from t where ts_us >= block_start_us and ts_us < block_end_us) x where not exists (select 1 from t t2 where t2.channel = x.channel and t2.ts_us < block_start_us and t2.value <= {t.NOMINAL_MAX})) as untrained from bl",
        q.READINGS,
        *q.TRUTH,
        q.BLOCKS,
    )
)
def fold_usable(spark, d):
    r, b = t.readings(spark, d), t.blocks(spark)
    events = truth.in_blocks(all_events(spark, d), b).groupBy("block").agg(F.count("*").alias("events"))
    tested = truth.in_blocks(r, b, "ts_us").select("block", "channel").distinct()
    nominal = r.where(F.col("value") <= t.NOMINAL_MAX).groupBy("channel").agg(F.min("ts_us").alias("first_us")).join(F.broadcast(b), F.col("first_us") < F.col("block_start_us")).select("block", "channel")
    untrained = tested.join(nominal, ["block", "channel"], "left_anti").groupBy("block").agg(F.count("*").alias("untrained"))
    return b.select("block").join(events, "block", "left").join(untrained, "block", "left").fillna(0)


# --- intervals ------------------------------------------------------------------------------------------------------------------------------


def alarm_spans(spark, d) -> DataFrame:
    a = main_alarms(spark, d)
    end = t.readings(spark, d).agg(F.max("ts_us")).first()[0]
    return metrics.detections(a, end, "channel")


@registered(q.query("select channel, min(lo) as a, max(hi) as b from (select *, sum(new) over (partition by channel order by lo, hi rows unbounded preceding) as g from (select *, case when lo > max(hi) over (partition by channel order by lo, hi rows between unbounded preceding and 1 preceding) + 1 then 1 else 0 end as new from iv)) group by channel, g", *q.BASE, *q.TRUTH, q.JUDGED))
def span_union(spark, d):
    return alarm_spans(spark, d)


@registered(q.query("select lo as a, hi as b from iu", *q.BASE, *q.TRUTH, q.JUDGED))
def detections_combined(spark, d):
    return intervals.union(alarm_spans(spark, d))


@registered(q.query("select greatest(iu.lo, tu.lo) as a, least(iu.hi, tu.hi) as b from iu join tu on iu.lo <= tu.hi and tu.lo <= iu.hi", *q.BASE, *q.TRUTH, q.JUDGED))
def span_intersect(spark, d):
    e, a, end = judged(spark, d)
    p = metrics.detections(a, end)
    return intervals.intersection(p, metrics._fragments(metrics.annotated(e)).select(F.col("a2").alias("a"), F.col("b2").alias("b")), metrics.CELL)


GAPS = "gaps as (select coalesce(lag(hi) over (order by lo) + 1, (select start_us * 2000 from rg)) as a, lo - 1 as b from tu union all select coalesce(max(hi) + 1, (select start_us * 2000 from rg)), (select end_us * 2000 from rg) from tu)"


@registered(q.query("select a, b from gaps where a <= b", *q.BASE, *q.TRUTH, q.JUDGED, GAPS))
def span_difference(spark, d):
    e, _, end = judged(spark, d)
    return intervals.complement(metrics.annotated(e).select(F.col("a2").alias("a"), F.col("b2").alias("b")), 2000 * t.TEST_US, 2000 * end)


@registered(q.query("select channel, count(*) as n, sum((hi + 1) // 2 - lo // 2)::bigint as ns from iv group by channel", *q.BASE, *q.TRUTH, q.JUDGED))
def span_length(spark, d):
    spans = alarm_spans(spark, d)
    return spans.groupBy("channel").agg(F.count("*").alias("n"), F.sum(intervals.length(F.col("a"), F.col("b"))).alias("ns"))


# --- metrics --------------------------------------------------------------------------------------------------------------------------------

EVENT_WISE = """hit as (select tn.id, iu.lo as p from tn join iu on iu.lo <= tn.hi and tn.lo <= iu.hi),
per as (select id, count(*) as hits from hit group by id),
x as (select (select count(*) from per) as tp, (select count(distinct id) from tn) as ids, (select coalesce(sum(greatest(hits - 1, 0)), 0) from per)::bigint as redundant, (select count(*) from iu where lo not in (select p from hit)) as fp,
 (select sum((b + 1) // 2 - a // 2)::bigint from gaps where a <= b) as nominal_ns,
 (select coalesce(sum((least(b, hi) + 1) // 2 - greatest(a, lo) // 2), 0)::bigint from gaps join iu on lo <= b and a <= hi where a <= b) as false_ns),
y as (select *, ids - tp as fn, case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as raw from x),
z as (select *, case when raw > 0 then 1 - false_ns / nominal_ns::double end as tnr, case when ids > 0 then tp / ids::double else 0 end as recall from y),
zz as (select *, raw * coalesce(tnr, 1) as precision from z)"""


@registered(q.query(f"select tp, fp, fn, redundant, nominal_ns, false_ns, {q.R6('precision')} as precision, {q.R6('tnr')} as tnr, {q.R6('recall')} as recall, {q.R6('case when 0.25 * precision + recall > 0 then 1.25 * precision * recall / (0.25 * precision + recall) else 0 end')} as f, {q.R6('case when tp + redundant > 0 then tp / (tp + redundant)::double else 0 end')} as alarming_precision from zz", *q.BASE, *q.TRUTH, q.JUDGED, GAPS, EVENT_WISE))
def event_wise(spark, d):
    e, a, end = judged(spark, d)
    return rounded(metrics.event_wise(e, a, t.TEST_US, end, t.BETA), "precision", "tnr", "recall", "f", "alarming_precision")


CHANNEL_WISE = """hc as (select tn.channel, tn.id, iv.lo as p from tn join iv on iv.channel = tn.channel and iv.lo <= tn.hi and tn.lo <= iv.hi)"""


@registered(q.query("select ch.channel, (select count(distinct id) from hc where hc.channel = ch.channel) as tp, (select count(*) from tn where tn.channel = ch.channel) - (select count(distinct id) from hc where hc.channel = ch.channel) as fn, (select count(*) from iv where iv.channel = ch.channel and not exists (select 1 from hc where hc.channel = iv.channel and hc.p = iv.lo)) as fp from (select distinct channel from t) ch", *q.BASE, *q.TRUTH, q.JUDGED, CHANNEL_WISE))
def event_wise_per_channel(spark, d):
    e, a, end = judged(spark, d)
    p, parts = metrics.detections(a, end, "channel"), metrics.annotated(e)
    touch = intervals.overlaps(p, parts, metrics.CELL, "channel")
    tp = touch.groupBy("channel").agg(F.count_distinct("id").alias("tp"))
    ids = parts.groupBy("channel").agg(F.count("*").alias("ids"))
    fp = p.join(touch.select("channel", "a").distinct(), ["channel", "a"], "left_anti").groupBy("channel").agg(F.count("*").alias("fp"))
    out = t.readings(spark, d).select("channel").distinct().join(tp, "channel", "left").join(ids, "channel", "left").join(fp, "channel", "left").fillna(0)
    return out.select("channel", "tp", (F.col("ids") - F.col("tp")).alias("fn"), "fp")


CHANNEL_AWARE = """ch as (select distinct channel from t),
ins as (select tn.id, iv.channel, greatest(iv.lo, tn.lo) as a, least(iv.hi, tn.hi) as b, tn.channel as own from tn join iv on iv.lo <= tn.hi and tn.lo <= iv.hi),
ca as (select tn.id, ch.channel, tn.channel = ch.channel as affected, exists (select 1 from ins where ins.id = tn.id and ins.channel = ch.channel) as hit,
 exists (select 1 from ins join tn o on o.channel = ins.channel and o.id <> ins.id and o.lo <= ins.b and ins.a <= o.hi where ins.id = tn.id and ins.channel = ch.channel) as excused from tn cross join ch),
cb as (select id, count(*) filter (affected and hit) as tp, count(*) filter (not affected and hit and not excused) as fp, count(*) filter (affected and not hit) as fn from ca group by id),
cc as (select *, case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as recall from cb)"""


@registered(q.query(f"select id, tp, fp, fn, {q.R6('precision')} as precision, {q.R6('recall')} as recall, {q.R6('case when 0.25 * precision + recall > 0 then 1.25 * precision * recall / (0.25 * precision + recall) else 0 end')} as f from cc", *q.BASE, *q.TRUTH, q.JUDGED, CHANNEL_AWARE))
def channel_aware(spark, d):
    e, a, end = judged(spark, d)
    return rounded(metrics.channel_aware(e, a, t.readings(spark, d).select("channel").distinct(), end, t.BETA), "precision", "recall", "f")


TIMING = """tq0 as (select tn.id, tn.lo, tn.hi, min(iv.lo) as first from tn join iv on iv.channel = tn.channel and iv.lo <= tn.hi and tn.lo <= iv.hi group by tn.id, tn.lo, tn.hi),
st as (select lo, lag(lo) over (order by lo) as previous from (select distinct lo from tn)),
tq1 as (select id, (hi - lo) // 2 as len, (first - lo) // 2 as lat, least((hi - lo) // 2, (lo - coalesce(previous, lo - (hi - lo))) // 2) as alpha from tq0 join st using (lo)),
tq as (select id, lat::bigint as latency_ns, lat / 1e9::double as latency_s, case when (alpha = 0 or len = 0) and lat = 0 then 1.0 when lat <= -alpha or lat >= len then 0.0 when lat <= 0 then pow((lat + alpha) / alpha::double, 2.0) else 1.0 / (1.0 + pow(lat / (len - lat)::double, 2.0)) end::double as quality from tq1)"""


@registered(q.query(f"select id, latency_ns, {q.R6('latency_s')} as latency_s, {q.R6('quality')} as quality from tq", *q.BASE, *q.TRUTH, q.JUDGED, TIMING))
def timing_quality(spark, d):
    e, a, end = judged(spark, d)
    return rounded(metrics.timing(e, a, end, t.EXPONENT), "latency_s", "quality")


DELAYS = "dl0 as (select te.id, te.start_us, arg_min(a.fired_at_us, a.t_start_us) as fired from te join a on a.channel = te.channel and a.t_start_us <= te.end_us and (a.t_end_us is null or a.t_end_us >= te.start_us) group by te.id, te.start_us), dl as (select id, (fired - start_us) / 1e6::double as delay_s from dl0)"


@registered(q.query(f"select id, {q.R6('delay_s')} as delay_s from dl", *q.BASE, *q.TRUTH, q.JUDGED, DELAYS))
def alarm_delays(spark, d):
    e, a, _ = judged(spark, d)
    return rounded(metrics.alarm_delays(e, a), "delay_s")


@registered(q.query(f"select count(*) as n, {q.R6('median(delay_s)')} as median, {q.R6('quantile_disc(delay_s, 0.9)')} as p90, {q.R6('max(delay_s)')} as max from dl", *q.BASE, *q.TRUTH, q.JUDGED, DELAYS))
def delay_distribution(spark, d):
    e, a, _ = judged(spark, d)
    return rounded(metrics.distribution(metrics.alarm_delays(e, a), "delay_s"), "median", "p90", "max")


@registered(q.query(f"select block, count(a.t_start_us) as alarms, {q.R6('count(a.t_start_us) * 86400 / any_value(observed_s)')} as per_day from ob join bl using (block) left join a on a.t_start_us >= block_start_us and a.t_start_us < block_end_us group by block", *q.BASE, *q.TRUTH, q.BLOCKS, OBSERVED))
def alarms_per_day(spark, d):
    b = t.blocks(spark)
    observed = truth.observed_seconds(truth.run_spans(with_runs(spark, d)), b)
    counts = truth.in_blocks(main_alarms(spark, d), b, "t_start_us").groupBy("block").agg(F.count("*").alias("alarms"))
    out = observed.join(counts, "block", "left").fillna(0, ["alarms"])
    return out.select("block", "alarms", r6(F.col("alarms") * 86400 / F.col("observed_s")).alias("per_day"))


@registered(q.query(f"select policy, count(*) as alarms, sum(n_firing)::bigint as firing, {q.R6('max(peak)')} as peak from a group by policy", q.READINGS, q.BOUNDS, q.latch(*ALL), q.ALARMS))
def gap_sensitivity(spark, d):
    s = t.readings(spark, d)
    rows = detect.scored(t.tested(s), t.limits(s, *ALL), by=("policy", "mission", "channel"))
    found = arbiter.alarms(rows, t.MEDIUM, t.HIGH, by=("policy", "mission", "channel"))
    return rounded(found.groupBy("policy").agg(F.count("*").alias("alarms"), F.sum("n_firing").alias("firing"), F.max("peak").alias("peak")), "peak")


@registered(q.query(f"select measure, count(v) as n, {q.R6('avg(v)')} as mean, {q.R6('min(v)')} as min, {q.R6('max(v)')} as max from (select block, 'events' as measure, count(ev.id)::double as v from bl left join ev on ev.start_us >= block_start_us and ev.start_us < block_end_us group by block union all select block, 'observed_s', observed_s from ob) group by measure", q.READINGS, *q.TRUTH, q.BLOCKS, OBSERVED))
def fold_summary(spark, d):
    b = t.blocks(spark)
    observed = truth.observed_seconds(truth.run_spans(with_runs(spark, d)), b)
    events = truth.in_blocks(all_events(spark, d), b).groupBy("block").agg(F.count("*").alias("events"))
    folds = b.select("block").join(observed, "block", "left").join(events, "block", "left").fillna(0, ["events"])
    return rounded(metrics.summary(folds, ["events", "observed_s"]), "mean", "min", "max")


# --- classification ---------------------------------------------------------------------------------------------------------------------------

JUDGE = "j as (select toxic = 1 as label, n_chars > 2000 as flagged, n_chars::double as score from labels join documents using (doc_id))"
CONFUSION = """k0 as (select count(*) filter (label and flagged) as tp, count(*) filter (not label and flagged) as fp, count(*) filter (label and not flagged) as fn, count(*) filter (not label and not flagged) as tn from j),
k1 as (select tp, fp, fn, tn, tp::double as a, fp::double as b, fn::double as c, tn::double as d from k0)"""


def judged_docs(spark, d) -> DataFrame:
    rows = t.table(spark, d, "labels").join(t.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select((F.col("toxic") == 1).alias("label"), (F.col("n_chars") > 2000).alias("flagged"), F.col("n_chars").cast("double").alias("score"))


@registered(q.query(f"select tp, fp, fn, tn, {q.R6('(a + d) / (a + b + c + d)')} as accuracy, {q.R6('case when a + b > 0 then a / (a + b) else 0 end')} as precision, {q.R6('case when a + c > 0 then a / (a + c) else 0 end')} as recall, {q.R6('case when a + b + c > 0 then 2 * a / (2 * a + b + c) else 0 end')} as f1, {q.R6('case when (a + b) * (c + d) > 0 and (a + c) * (b + d) > 0 then ((a + b + c + d) * a - (a + b) * (a + c)) / sqrt((a + b) * (c + d) * (a + c) * (b + d)) else 0 end')} as mcc from k1", JUDGE, CONFUSION))
def confusion_metrics(spark, d):
    return rounded(metrics.confusion(judged_docs(spark, d)), "accuracy", "precision", "recall", "f1", "mcc")


CURVE = """cv0 as (select score, count(*) filter (label) as pos, count(*) filter (not label) as neg from j group by score),
cv as (select score, (sum(pos) over w)::bigint as tp, (sum(neg) over w)::bigint as fp, sum(pos) over w / (sum(pos) over ())::double as recall, sum(pos) over w / (sum(pos) over w + sum(neg) over w)::double as precision, sum(neg) over w / (sum(neg) over ())::double as fpr from cv0 window w as (order by score desc rows unbounded preceding))"""


@registered(q.query(f"select score, tp, fp, {q.R6('recall')} as recall, {q.R6('precision')} as precision, {q.R6('fpr')} as fpr from cv", JUDGE, CURVE))
def pr_curve(spark, d):
    return rounded(metrics.curve(judged_docs(spark, d)).drop("pos", "neg"), "recall", "precision", "fpr")


@registered(q.query(f"select {q.R6('sum(area)')} as average_precision from (select (recall - coalesce(lag(recall) over (order by score desc), 0)) * precision as area from cv)", JUDGE, CURVE))
def average_precision(spark, d):
    return rounded(metrics.average_precision(metrics.curve(judged_docs(spark, d))), "average_precision")


@registered(q.query(f"select {q.R6('sum(area)')} as roc_auc from (select (fpr - coalesce(lag(fpr) over w, 0)) * (recall + coalesce(lag(recall) over w, 0)) / 2 as area from cv window w as (order by score desc))", JUDGE, CURVE))
def roc_auc(spark, d):
    return rounded(metrics.roc_auc(metrics.curve(judged_docs(spark, d))), "roc_auc")


SEGMENT_CLASS = """sc as (select lab.segment, max(s.score) as score from lab join s on s.channel = lab.channel and s.ts_us = lab.ts_us group by lab.segment),
tst as (select seg.*, sc.score, exists (select 1 from a where a.channel = seg.channel and a.t_start_us <= seg.end_us and (a.t_end_us is null or a.t_end_us >= seg.start_us)) as flagged from seg join sc using (segment) where not seg.train)"""


@registered(q.query(f"select segment, channel, anomaly as label, flagged, {q.R6('score')} as score from tst", *q.BASE, q.LABELLED, SEGMENT_CLASS))
def segment_classification(spark, d):
    lab, scores, a = t.labelled(spark, d), main_scores(spark, d), main_alarms(spark, d)
    best = lab.join(scores.select("channel", "ts_us", "score"), ["channel", "ts_us"]).groupBy("segment").agg(F.max("score").alias("score"))
    seg = truth.segments(lab).where("not train").join(best, "segment")
    spans = a.select("channel", F.col("t_start_us").alias("a2"), F.coalesce("t_end_us", F.lit(t.END_US)).alias("b2"))
    hit = intervals.overlaps(seg.select("segment", "channel", F.col("start_us").alias("a"), F.col("end_us").alias("b")), spans, t.BUCKET_US, "channel").select("segment").distinct()
    out = seg.join(hit.withColumn("flagged", F.lit(True)), "segment", "left")
    return rounded(out.select("segment", "channel", F.col("anomaly").alias("label"), F.coalesce("flagged", F.lit(False)).alias("flagged"), "score"), "score")
