"""Running totals over an ordered table that no single task orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable_checkpoint


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str, parts: int | None = None) -> DataFrame:
    """Adds ``_before``, the weight of all earlier rows of the same key, and ``_total``, that of the key.

    Rows are dealt to ranges of ``(key, order)``, so a key that holds every row still spreads over all
    ranges; each range is ordered on its own, and only one total per key and range is ordered by key.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable_checkpoint(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    series = W.partitionBy(*keys)
    earlier = series.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_part").agg(F.sum(weight).alias("_w")).select(
        *keys, "_part", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_start"), F.sum("_w").over(series).alias("_total"))
    inside = W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return ranged.join(totals, [*keys, "_part"]).withColumn(
        "_before", F.col("_start") + F.coalesce(F.sum(weight).over(inside), F.lit(0))).drop("_part", "_start")
