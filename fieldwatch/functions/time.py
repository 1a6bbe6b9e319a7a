"""Time expressions on naive (zone-free) timestamps, held as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
NTZ = "timestamp_ntz"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_us(ts: str | Column) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def from_us(us: Column) -> Column:
    return F.timestamp_micros(us).cast(NTZ)


def floor_div(value: Column, width: int | Column) -> Column:
    """Integer floor division that also holds before 1970."""
    width = width if isinstance(width, Column) else F.lit(width)
    return ((value - F.pmod(value, width)) / width).cast("bigint")


def trunc_to(unit: str, ts: str | Column) -> Column:
    return F.date_trunc(unit, col(ts)).cast(NTZ)


def hour_index(ts: str | Column) -> Column:
    return floor_div(epoch_us(ts), HOUR_US)


def add_seconds(ts: str | Column, seconds: Column | float) -> Column:
    seconds = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    return from_us(epoch_us(ts) + F.round(seconds * 1e6).cast("bigint"))


def hours_between(later: str | Column, earlier: str | Column) -> Column:
    return (epoch_us(later) - epoch_us(earlier)) / F.lit(float(HOUR_US))


def minutes_between(later: str | Column, earlier: str | Column) -> Column:
    return (epoch_us(later) - epoch_us(earlier)) / F.lit(6e7)
