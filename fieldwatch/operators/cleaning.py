"""Projection, coercion, deduplication and keyword classification."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import finite, flag, to_double


def to_number(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_double(c) for c in cols})


def to_timestamps(df: DataFrame, patterns: Mapping[str, str | None],
                  required: Sequence[str] = ()) -> DataFrame:
    """Parse text times (bad text becomes NULL), then drop rows missing a required column."""
    def parse(c: str, pattern: str | None) -> Column:
        fmt = F.lit(pattern) if pattern else None
        return F.try_to_timestamp(F.col(c), fmt).cast("timestamp_ntz") if fmt is not None \
            else F.col(c).try_cast("timestamp_ntz")
    df = df.withColumns({c: parse(c, p) for c, p in patterns.items()})
    return df.na.drop(subset=list(required)) if required else df


def _pick(df: DataFrame, group: Sequence[str], order: Column, pick) -> DataFrame:
    """One whole row per group; combined map-side, so copies never meet in one task."""
    chosen = df.groupBy(*group).agg(
        pick(F.struct(*[F.col(c) for c in df.columns]), order).alias("_row"))
    return chosen.select("_row.*")


def dedupe_most_complete(df: DataFrame, keys: Sequence[str], ts: str,
                         measures: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """One row per key and time: most measures present wins, then the earliest tie value."""
    missing = sum((F.col(m).isNull().cast("int") for m in measures), F.lit(0))
    return _pick(df, [*keys, ts], F.struct(missing, *[F.col(t) for t in ties]), F.min_by)


def dedupe_last(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str]) -> DataFrame:
    return _pick(df, [*keys, ts], F.struct(*[F.col(o) for o in order]), F.max_by)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key tuple, e.g. ``(site, log_time, message)`` of an alarm log."""
    return _pick(df, keys, F.struct(*[F.col(o) for o in order]), F.min_by)


def null_implausible(df: DataFrame,
                     bounds: Mapping[str, tuple[float, float]] = K.PLAUSIBLE) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).between(lo, hi), F.col(c))
                           for c, (lo, hi) in bounds.items()})


def category_of(message: str | Column,
                keywords: Mapping[str, Sequence[str]] = K.CATEGORY_KEYWORDS,
                default: str = "OTHER") -> Column:
    """First category one of whose keywords occurs as a substring."""
    text = F.upper(F.coalesce(F.col(message) if isinstance(message, str) else message, F.lit("")))
    rule = F
    for name, words in keywords.items():
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        rule = rule.when(hit, F.lit(name))
    return rule.otherwise(F.lit(default))


def categorise(df: DataFrame, message: str,
               keywords: Mapping[str, Sequence[str]] = K.CATEGORY_KEYWORDS) -> DataFrame:
    return df.withColumn("category", category_of(message, keywords))


def word_pattern(words: Sequence[str]) -> str:
    # (?U): word boundaries follow Unicode, whatever the JDK's default
    body = "|".join(re.escape(w).replace("\\ ", " ") for w in words)
    return rf"(?U)\b(?:{body})\b"


def word_flag(message: str | Column, words: Sequence[str]) -> Column:
    text = F.lower(F.coalesce(F.col(message) if isinstance(message, str) else message, F.lit("")))
    return flag(text.rlike(word_pattern(words)))


def keyword_flags(df: DataFrame, message: str,
                  flags: Mapping[str, Sequence[str]] = K.FLAG_KEYWORDS) -> DataFrame:
    return df.withColumns({name: word_flag(message, words) for name, words in flags.items()})


def finite_or_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(c) for c in cols})


def with_family(df: DataFrame, dim: DataFrame, unit_col: str, dim_unit: str = "unit",
                dim_family: str = "family", default: str = "unknown") -> DataFrame:
    """Family of each unit; Spark chooses broadcast or shuffle from the dimension's size."""
    lookup = dim.select(F.col(dim_unit).alias(unit_col), F.col(dim_family).alias("_family"))
    return (df.join(lookup, unit_col, "left")
              .withColumn("family", F.coalesce("_family", F.lit(default))).drop("_family"))


def filter_episodes(df: DataFrame, equipment: str | None = None, severity: str | None = None,
                    start: str | None = None, end: str | None = None) -> DataFrame:
    if equipment is not None:
        df = df.filter(F.col("equipment") == equipment)
    if severity is not None:
        df = df.filter(F.col("severity") == severity)
    if start is not None:
        df = df.filter(F.col("start") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col("start") <= F.lit(end).cast("timestamp_ntz"))
    return df


def zero_fill(df: DataFrame, cols: Sequence[str], floor: float = 0) -> DataFrame:
    return df.withColumns({c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(floor))
                           for c in cols})


def split_rejects(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows meeting every domain bound, and the others with the names of the broken rules."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
                                       for name, ok in rules.items()]))
    checked = df.withColumn("broken_rules", broken)
    good = checked.filter(F.size("broken_rules") == 0).drop("broken_rules")
    return good, checked.filter(F.size("broken_rules") > 0)
