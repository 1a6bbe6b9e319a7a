"""Seeded order within a source, without ordering a whole source in one task.

A row's place is a random hash; its first digits name a slice. Slice totals are small and prefix
sums over them give every slice its start, so rows are only ever ordered inside one slice of one
source, however large the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICE_DIGITS = 3   # 16 ** 3 = 4,096 slices of every source; raise it with the rows of the largest source


def slice_of(order: Column, digits: int = SLICE_DIGITS) -> Column:
    return F.conv(F.substring(order, 1, digits), 16, 10).cast("int")


def with_starts(rows: DataFrame, keys: list[str], part: str, measures: dict[str, Column]) -> DataFrame:
    """Totals of ``measures`` per ``(keys, part)`` and, as ``<name>_start`` and ``<name>_total``,
    what earlier parts of the same keys hold and what the keys hold in all.

    The windows see one row per part: at most 4,096 for a source.
    """
    parts = rows.groupBy(*keys, part).agg(*[F.sum(m).cast("bigint").alias(n) for n, m in measures.items()])
    earlier = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    columns = {}
    for n in measures:
        columns[f"{n}_start"] = F.coalesce(F.sum(n).over(earlier), F.lit(0))
        columns[f"{n}_total"] = F.sum(n).over(whole)
    return parts.withColumns(columns).drop(*measures)
