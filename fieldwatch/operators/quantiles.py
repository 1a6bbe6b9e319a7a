"""Exact per-key quantiles of raw values without holding a key in one task.

Equal values are counted together first; running totals over ranges of the value then show which
distinct value holds a wanted rank. One path serves every size, and a task orders one range of the
distinct values, about a ``spark.sql.shuffle.partitions``-th of them, whatever their key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .ranks import running_totals

ACCURACY = 10_000   # of the approximate form


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    parts: int | None = None) -> DataFrame:
    """One row per key and probability: ``prob, n, quantile`` (linear interpolation)."""
    values = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    counts = values.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = running_totals(counts, keys, ["_v"], "_c", parts)
    last = F.col("_total") - 1
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.lit(side).alias("side"),
                                F.least(F.floor(F.lit(float(p)) * last) + side, last).alias("rank"))
                       for p in probs for side in (0, 1)])
    held = F.filter(wanted, lambda w: (w["rank"] >= F.col("_before")) & (w["rank"] < F.col("_before") + F.col("_c")))
    hits = placed.select(*keys, "_v", "_total", F.explode(held).alias("_w")).select(*keys, "_v", "_total", "_w.*")
    ends = hits.groupBy(*keys, "prob").agg(F.max("_total").alias("n"), F.max(F.when(F.col("side") == 0, F.col("_v"))).alias("_lo"),
                                           F.max(F.when(F.col("side") == 1, F.col("_v"))).alias("_hi"))
    share = F.col("prob") * (F.col("n") - 1)
    share = share - F.floor(share)
    return ends.select(*keys, "prob", "n", F.when(share == 0, F.col("_lo")).otherwise(
        F.col("_lo") + share * (F.col("_hi") - F.col("_lo"))).alias("quantile"))


def quantile_columns(df: DataFrame, keys: Sequence[str], value: str,
                     probs: dict[str, float], **options) -> DataFrame:
    """One row per key, one column per named probability."""
    long = exact_quantiles(df, keys, value, list(probs.values()), **options)
    return long.groupBy(*keys).agg(*[
        F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(name)
        for name, p in probs.items()])


def tukey(df: DataFrame, keys: Sequence[str], value: str,
          factors: dict[str, float] = K.TUKEY_FACTORS, approx: bool = False,
          require: bool = False) -> DataFrame:
    """q1, q3, iqr and lower/upper bounds per factor; ``require`` fails on an empty series."""
    if approx:
        q = F.percentile_approx(value, [0.25, 0.75], ACCURACY)
        base = df.groupBy(*keys).agg(q.alias("_q")).select(
            *keys, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"))
    else:
        base = quantile_columns(df, keys, value, {"q1": 0.25, "q3": 0.75})
    if require and base.isEmpty():
        raise ValueError("no values to derive thresholds from")
    base = base.withColumn("iqr", F.col("q3") - F.col("q1"))
    return base.withColumns({
        name: bound for f, x in factors.items() for name, bound in (
            (f"{f}_lower", F.col("q1") - F.lit(x) * F.col("iqr")),
            (f"{f}_upper", F.col("q3") + F.lit(x) * F.col("iqr")))})
