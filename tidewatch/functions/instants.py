"""Time as integers: microseconds for samples, nanoseconds on a doubled grid for intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ that holds UTC; independent of the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def seconds(us: Column) -> Column:
    return us / F.lit(float(SECOND))


def nanos(us: Column) -> Column:
    return us * F.lit(1000).cast("long")


def stamp(us: Column) -> Column:
    """``YYYYMMDDTHHMMSS.ffffffZ`` in UTC, by arithmetic on the civil calendar, so that no session zone enters."""
    ntz = F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.concat(F.date_format(ntz, "yyyyMMdd'T'HHmmss.SSSSSS"), F.lit("Z"))


def of_iso(text: Column) -> Column:
    """Microseconds of an ISO-8601 instant that states its zone; null for anything else, naive instants included."""
    return F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.unix_micros(F.try_to_timestamp(text)))


def event_id(mission: Column, detector: Column, channel: Column, onset_us: Column) -> Column:
    return F.concat_ws(":", mission, detector, channel, stamp(onset_us))


def channel_rank_key(seed: int | str, channel: Column) -> Column:
    """What channels are ordered by among samples of one instant."""
    return F.sha2(F.concat(F.lit(f"{seed}/"), channel), 256)
