"""Small numeric expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .time import col


def clip(c: str | Column, low: float, high: float) -> Column:
    """Clamp while keeping NULL as NULL (``greatest``/``least`` alone would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def finite(c: str | Column) -> Column:
    c = col(c).cast("double")
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(c.isNotNull() & ~bad, c)


def safe_div(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def to_double(c: str | Column) -> Column:
    return col(c).try_cast("double")


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def present(c: Column, digits: int) -> Column:
    """Presentation rounding: binary value, half to even (not Spark's decimal half-up)."""
    scale = F.lit(float(10 ** digits))
    return F.rint(c * scale) / scale
