"""Time arithmetic on zone-less timestamps, exact to the microsecond."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
DAY_SECONDS = 86_400


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def micros(ts) -> Column:
    """Microseconds since 1970-01-01, as BIGINT."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, _col(ts))


def seconds_between(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)) / F.lit(float(MICROS))


def add_micros(ts, us) -> Column:
    return F.timestamp_add("MICROSECOND", _col(us), _col(ts))


def add_seconds(ts, seconds) -> Column:
    """Adds a DOUBLE number of seconds, rounded to the microsecond."""
    return add_micros(ts, to_micros(seconds))


def to_micros(seconds) -> Column:
    return F.round(_col(seconds) * float(MICROS)).cast("bigint")


def daytime(ts) -> Column:
    """Second of the day."""
    ts = _col(ts)
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def weekday(ts) -> Column:
    """Monday is 0."""
    return F.weekday(_col(ts))
