"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidewatch.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[str]:
    def value(v):
        if v is None or v is pd.NA or v != v:
            return None
        return str(v) if isinstance(v, (str, bool)) or type(v).__name__ == "bool_" else round(float(v), 9)

    return sorted(str([value(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, sql, name):
    mine, theirs = QUERIES[name](spark, DATA).toPandas(), sql.execute(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert plain(mine) == plain(theirs)


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """The events three times, under shifted keys: every channel has three samples an instant."""
    d = tmp_path_factory.mktemp("repeated")
    con = duckdb.connect()
    con.execute(f"copy (select event_id + k * 100000 as event_id, ts, user_id, event_type, value, props from range(3) r(k), '{DATA}/events.parquet') to '{d}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{d}/events.parquet'")
    return str(d), con


@pytest.mark.parametrize("name", ["alarm_latch", "alarms_by_detector", "gap_sensitivity", "rate_of_change"])
def test_repeated_instants_equal_sql(spark, repeated, name):
    data, con = repeated
    mine, theirs = QUERIES[name](spark, data).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert plain(mine) == plain(theirs)


@pytest.fixture(scope="module")
def regular(tmp_path_factory):
    """Two channels every 32 s, so that many rates end in a half at the seventh place; a silence, and every 8th instant twice. The rows lie in falling event_id."""
    d = tmp_path_factory.mktemp("regular")
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(
        """create table events as select i as event_id, make_timestamp(1704067200000000 + ((i // 18) * 8 + least(i % 18 // 2, 7)) * 32000000 + (i // 9000) * 10800000000) as ts,
        i % 7 as user_id, if(i % 2 = 0, 'click', 'view') as event_type, (i * i * 7919 % 50021) / 100.0::double as value, '{"k": 1}' as props from range(36000) r(i) order by i"""
    )
    con.execute(f"copy (select * from events order by event_id desc) to '{d}/events.parquet' (format parquet)")
    return str(d), con


def test_rate_of_change_rounds_and_orders_as_its_sql(spark, regular):
    data, con = regular
    mine, theirs = QUERIES["rate_of_change"](spark, data).toPandas(), con.execute(ORACLES["rate_of_change"]).df()
    assert plain(mine) == plain(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
