"""SQL of the registered queries, in common table expressions that later ones build on. The alarm latch steps row by row in a recursive
expression, so it does not share the window formulation of the operators."""

from __future__ import annotations

from tidewatch.plans import tables as t

R6 = lambda x: f"round({x}, 6)"

READINGS = "t as (select 'events' as mission, event_type as channel, epoch_us(ts) as ts_us, value, 'ok' as quality from events)"
CODES = "c as (select 'events' as mission, event_type as channel, epoch_us(ts) as ts_us, cast(json_extract_string(props, '$.k') as double) as value from events)"
BOUNDS = f"""b as (select channel, lo - {t.MARGIN}::double * (hi - lo) as low, hi + {t.MARGIN}::double * (hi - lo) as high from
 (select channel, min(value) as lo, max(value) as hi from t where ts_us < {t.TEST_US} and value <= {t.NOMINAL_MAX} group by channel) where hi > lo)"""


def _policy_rows(names: tuple[str, ...]) -> str:
    rows = []
    for n in names:
        p = t.POLICIES[n]
        rows.append(f"('{n}', {p.hysteresis}::double, {int(p.max_gap_s * 1e6)}, {p.samples or 'null'}::int, {p.seconds or 'null'}::double)")
    return ", ".join(rows)


def latch(*names: str) -> str:
    """Recursive state machine over the test part, for each policy and channel."""
    return f"""p as (select * from (values {_policy_rows(names or (t.MAIN,))}) as v(policy, hysteresis, gap_us, n, s)),
e as (select policy, channel, ts_us, value, hysteresis, gap_us, n, s, low, high, greatest(low - value, value - high, 0) / (high - low) as score,
 low + hysteresis * (high - low) <= value and value <= high - hysteresis * (high - low) as inside,
 row_number() over (partition by policy, channel order by ts_us) as k
 from t join b using (channel) cross join p where ts_us >= {t.TEST_US} and isfinite(value)),
s as (select policy, channel, k, ts_us, score, case when score > 0 then ts_us end as run_us, case when score > 0 then 1 else 0 end as run_n,
 case when score > 0 and (n <= 1 or 0 >= s) then ts_us end as onset_us from e where k = 1
 union all
 select policy, channel, k, ts_us, score, run_us, run_n,
 case when held is not null then case when score > 0 or not inside then held end
 when score > 0 and (run_n >= n or (ts_us - run_us) / 1e6 >= sec) then run_us end
 from (select e.policy, e.channel, e.k, e.ts_us, e.score, e.inside, e.n, e.s as sec,
 case when e.ts_us - s.ts_us > e.gap_us then null else s.onset_us end as held,
 case when not e.score > 0 then null when e.ts_us - s.ts_us > e.gap_us or s.run_us is null then e.ts_us else s.run_us end as run_us,
 case when not e.score > 0 then 0 when e.ts_us - s.ts_us > e.gap_us then 1 else s.run_n + 1 end as run_n
 from s join e on e.policy = s.policy and e.channel = s.channel and e.k = s.k + 1))"""


ALARMS = f"""l as (select policy, channel, max(ts_us) as last_us from s group by policy, channel),
a as (select *, case when peak >= {t.HIGH} then 'high' when peak >= {t.MEDIUM} then 'medium' else 'low' end as severity,
 'events:r0_limits:' || channel || ':' || strftime(make_timestamp(t_start_us), '%Y%m%dT%H%M%S.%fZ') as id from
 (select s.policy, s.channel, onset_us as t_start_us, case when max(last_us) > max(ts_us) then max(ts_us) end as t_end_us, min(ts_us) as fired_at_us, max(score) as peak, count(*) as n_firing
 from s join l on l.policy = s.policy and l.channel = s.channel where onset_us is not null group by s.policy, s.channel, onset_us))"""

LABELLED = f"""lab0 as (select channel, ts_us, value, ts_us // {t.BUCKET_US} as bucket from t),
lab as (select (bucket * 8 + list_position(['click', 'error', 'purchase', 'signup', 'view'], channel))::bigint as segment, channel, ts_us, value, 3600 as sampling_s, max(value) over (partition by channel, bucket) > 150 as anomaly from lab0),
seg as (select segment, channel, sampling_s, bool_or(anomaly) as anomaly, segment % 4 <> 0 as train, min(ts_us) as start_us, max(ts_us) as end_us, count(*) as samples from lab group by segment, channel, sampling_s)"""
RUNS = f"""r0 as (select *, case when start_us - lag(end_us) over (partition by channel order by start_us, segment) > {t.PERIODS} * sampling_s * 1000000 then 1 else 0 end as broken from seg),
r as (select *, sum(broken) over (partition by channel order by start_us, segment rows unbounded preceding)::bigint as run from r0)"""
EVENTS = """ev0 as (select *, sum(case when anomaly then 0 else 1 end) over (partition by channel, run order by start_us, segment rows unbounded preceding) as stretch from r),
ev as (select channel || ':' || arg_min(segment, start_us)::varchar as id, channel, min(start_us) as start_us, max(end_us) as end_us, count(*) as n from ev0 where anomaly group by channel, run, stretch)"""
BLOCKS = f"bl as (select * from (values (1, {t.TEST_US}, {t.MIDDLE_US}), (2, {t.MIDDLE_US}, {t.END_US})) as v(block, block_start_us, block_end_us))"
#: Labelled events of the test part, and alarms as doubled nanoseconds; the range ends with the last reading.
JUDGED = f"""te as (select * from ev where start_us >= {t.TEST_US}),
rg as (select {t.TEST_US} as start_us, max(ts_us) as end_us from t),
iv as (select channel, t_start_us * 2000 as lo, case when t_end_us is null then (select end_us from rg) * 2000 else (t_end_us * 1000 + 1) * 2 - 1 end as hi from a),
iu0 as (select *, case when lo > max(hi) over (order by lo, hi rows between unbounded preceding and 1 preceding) + 1 then 1 else 0 end as new from iv),
iu as (select min(lo) as lo, max(hi) as hi from (select *, sum(new) over (order by lo, hi rows unbounded preceding) as g from iu0) group by g),
tn as (select id, channel, start_us * 2000 as lo, end_us * 2000 as hi from te),
tu0 as (select *, case when lo > max(hi) over (order by lo, hi rows between unbounded preceding and 1 preceding) + 1 then 1 else 0 end as new from tn),
tu as (select min(lo) as lo, max(hi) as hi from (select *, sum(new) over (order by lo, hi rows unbounded preceding) as g from tu0) group by g)"""
BASE = [READINGS, BOUNDS, latch(), ALARMS]
TRUTH = [LABELLED, RUNS, EVENTS]


def query(select: str, *parts: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n" + select
