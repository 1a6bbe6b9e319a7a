"""The dense hourly grid: A1, A2, A10-A12, I1, I2, J1-J4, J7.

Rows are pre-aggregated to one per ``(site, hour)`` before anything is ordered by site, so
a per-site window here holds at most the hours of that site's history, however many raw
readings stand behind them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import flag, present
from ..functions.time import HOUR_US, add_seconds, epoch_us, floor_div, from_us, trunc_to
from .timeblocks import BLOCK, DAY, US, block_window

HOUR = "timestamp"


def densify(hourly: DataFrame, keys: Sequence[str], ts: str = HOUR) -> DataFrame:
    """Every hour between each key's first and last one; added hours hold NULLs.

    Each row opens the empty hours up to its successor, so the input is read once.
    """
    hour = F.expr("interval 1 hour")
    following = F.lead(ts).over(W.partitionBy(*keys).orderBy(ts))
    last = F.coalesce(following - hour, F.col(ts))
    spread = hourly.withColumn("_own", F.col(ts)).withColumn("_last", last).withColumn(
        ts, F.explode(F.sequence(F.col("_own"), F.col("_last"), hour)))
    values = [c for c in hourly.columns if c not in (*keys, ts)]
    return spread.withColumns({c: F.when(F.col(ts) == F.col("_own"), F.col(c)) for c in values}) \
                 .drop("_own", "_last")


def hourly_readings(df: DataFrame, keys: Sequence[str], ts: str,
                    temperature: str = "temperature", humidity: str = "humidity") -> DataFrame:
    """Hourly mean and sample deviation of both measures, readings counted, empty hours kept."""
    hourly = df.groupBy(*keys, trunc_to("hour", ts).alias(HOUR)).agg(
        F.avg(temperature).alias("temperature"), F.avg(humidity).alias("humidity"),
        F.stddev_samp(temperature).alias("temp_std_1h"),
        F.stddev_samp(humidity).alias("humidity_std_1h"),
        F.count(temperature).alias("observation_count"))
    return densify(hourly, keys).withColumn(
        "observation_count", F.coalesce("observation_count", F.lit(0)))


def hourly_counts(df: DataFrame, keys: Sequence[str], ts: str,
                  flags: Mapping[str, str]) -> DataFrame:
    """Hourly sums of 0/1 flags as ``<name>_count``; hours without alarms count 0."""
    hourly = df.groupBy(*keys, trunc_to("hour", ts).alias(HOUR)).agg(
        *[F.sum(f).alias(f"{n}_count") for f, n in flags.items()])
    return densify(hourly, keys).withColumns(
        {f"{n}_count": F.coalesce(f"{n}_count", F.lit(0)) for n in flags.values()})


def interpolate(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
                limit: int = 3) -> DataFrame:
    """Linear fill of the first ``limit`` missing rows of every gap of a gridded series.

    Trailing gaps hold the last value (same limit); leading gaps stay missing.
    """
    ahead = W.partitionBy(*keys).orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy(*keys).orderBy(F.col(ts).desc()).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(ts)))
    helpers = []
    for c in cols:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).alias("v")))
        df = (df.withColumn(f"_p_{c}", F.last(known, ignorenulls=True).over(ahead))
                .withColumn(f"_n_{c}", F.last(known, ignorenulls=True).over(back)))
        helpers += [f"_p_{c}", f"_n_{c}"]
    for c in cols:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        line = p["v"] + (n["v"] - p["v"]) * (F.col("_i") - p["i"]) / (n["i"] - p["i"])
        near = p.isNotNull() & (F.col("_i") - p["i"] <= limit)
        df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c))
                           .when(near & n.isNotNull(), line).when(near, p["v"]))
    return df.drop("_i", *helpers)


def observation_bounds(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    span = F.floor((epoch_us(F.max(ts)) - epoch_us(F.min(ts))) / F.lit(24 * HOUR_US))
    return df.groupBy(*keys).agg(F.max(ts).alias("last_ts"),
                                 F.greatest(span, F.lit(1)).cast("bigint").alias("span_days"))


def daily_history(hourly: DataFrame, keys: Sequence[str], days: int,
                  cols: Mapping[str, str], ts: str = HOUR) -> DataFrame:
    """Daily means of complete days (no missing score), the last ``days`` of them."""
    daily = hourly.groupBy(*keys, trunc_to("day", ts).alias("day")).agg(
        *[F.avg(c).alias(n) for n, c in cols.items()]).na.drop(subset=list(cols))
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("day").desc()))
    return daily.withColumn("_rk", newest).filter(F.col("_rk") <= days).drop("_rk").withColumns(
        {n: present(F.col(n), 1) for n in cols})


def _width(step_hours: int | Column) -> Column:
    step = step_hours if isinstance(step_hours, Column) else F.lit(step_hours)
    return step.cast("bigint") * F.lit(HOUR_US)


def resample_end(df: DataFrame, keys: Sequence[str], ts: str, value: str,
                 step_hours: int | Column, n: int) -> DataFrame:
    """Means per step on a grid that ends on the last observation, the last ``n`` of them.

    A bucket holds the rows in ``(label - step, label]``; the final label is the last
    observation itself.
    """
    width = _width(step_hours)
    last = F.max(epoch_us(ts)).over(W.partitionBy(*keys))
    behind = floor_div(F.col("_last") - epoch_us(ts), width)
    binned = df.withColumn("_last", last).withColumn(
        "timestamp", from_us(F.col("_last") - behind * width))
    means = binned.groupBy(*keys, "timestamp").agg(F.avg(value).alias("value")).na.drop(
        subset=["value"])
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("timestamp").desc()))
    return means.withColumn("_rk", newest).filter(F.col("_rk") <= n).drop("_rk")


def regrid(anchor: DataFrame, trajectory: DataFrame, keys: Sequence[str], step: int | str,
           cols: Sequence[str] = ("value", "lower", "upper"), ts: str = "timestamp") -> DataFrame:
    """Trajectory points on a display grid that starts at the anchor (anchor row removed).

    Means per step where several points fall into one, straight lines between points where
    the grid is finer.  ``step``: hours, or the anchor's column holding them.
    """
    step = F.col(step) if isinstance(step, str) else F.lit(step)
    start = anchor.select(*keys, epoch_us(ts).alias("_a"), _width(step).alias("_w"))
    both = anchor.select(*keys, ts, *cols).unionByName(trajectory.select(*keys, ts, *cols))
    placed = both.join(start, list(keys))
    slot = floor_div(epoch_us(ts) - F.col("_a"), F.col("_w"))
    binned = placed.groupBy(*keys, "_a", "_w", slot.alias("_slot")).agg(
        *[F.avg(c).alias(c) for c in cols], F.max(epoch_us(ts)).alias("_end"))
    # every known slot also opens the empty ones up to the next known slot
    w = W.partitionBy(*keys).orderBy("_slot")
    until = F.coalesce(F.lead("_slot").over(w) - 1, F.col("_slot"))
    spread = binned.withColumn("_until", until).withColumn(
        "_end", F.max("_end").over(W.partitionBy(*keys))).withColumn(
        "_own", F.col("_slot")).withColumn("_slot", F.explode(F.sequence("_own", "_until")))
    dense = spread.withColumns({c: F.when(F.col("_slot") == F.col("_own"), F.col(c)) for c in cols})
    filled = interpolate(dense, keys, "_slot", cols, limit=1 << 30)
    stamp = F.col("_a") + F.col("_slot") * F.col("_w")
    return filled.filter((F.col("_slot") > 0) & (stamp <= F.col("_end"))).select(
        *keys, from_us(stamp).alias(ts), *cols)


def join_domains(grid: DataFrame, *domains: DataFrame, on: Sequence[str]) -> DataFrame:
    for domain in domains:
        grid = grid.join(domain, list(on), "left")
    return grid


def attach_state(df: DataFrame, states: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(states, list(on))


def asof_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str,
                 tolerance: float, cols: Sequence[str], block_seconds: float = DAY) -> DataFrame:
    """Nearest right row within ``tolerance`` seconds; an exact tie takes the later row.

    Left and right rows are merged in time order per ``(key, block)`` and each left row looks
    at its latest predecessor and earliest successor: no pairs are formed.  Right rows are
    copied into the blocks within tolerance.
    """
    width, reach = int(block_seconds * 1e6), int(tolerance * 1e6)
    payload = F.struct(F.col(US).alias("us"), *[F.col(c) for c in cols])
    r = right.withColumn(US, epoch_us(ts)).withColumn("_pay", payload).withColumn(
        BLOCK, F.explode(F.sequence(floor_div(F.col(US) - F.lit(reach), width),
                                    floor_div(F.col(US) + F.lit(reach), width))))
    r = r.select(*keys, BLOCK, US, "_pay", F.lit(0).alias("_left"))
    row = F.struct(*[F.col(c) for c in left.columns])
    lft = left.withColumn("_row", row).withColumn(US, epoch_us(ts)).withColumn(
        BLOCK, floor_div(F.col(US), width)).select(*keys, BLOCK, US, F.lit(1).alias("_left"), "_row")
    both = lft.unionByName(r, allowMissingColumns=True)
    running = (W.unboundedPreceding, 0)
    seen = F.last("_pay", ignorenulls=True)
    both = (both.withColumn("_b", seen.over(
                block_window(keys, order=(US, "_left")).rowsBetween(*running)))
                .withColumn("_f", seen.over(block_window(
                    keys, order=(F.col(US).desc(), "_left")).rowsBetween(*running))))
    db, df_ = F.col(US) - F.col("_b.us"), F.col("_f.us") - F.col(US)
    back_ok, ahead_ok = db <= reach, df_ <= reach
    best = F.when(ahead_ok & (~F.coalesce(back_ok, F.lit(False)) | (df_ <= db)), F.col("_f")) \
            .when(back_ok, F.col("_b"))
    hits = both.filter(F.col("_left") == 1).withColumn("_hit", best)
    return hits.select("_row.*", from_us(F.col("_hit.us")).alias("matched_ts"),
                       *[F.col(f"_hit.{c}").alias(c) for c in cols])


def asof_backward(df: DataFrame, keys: Sequence[str], ts: str, offset_hours: float,
                  cols: Sequence[str], fallback: str = "first") -> DataFrame:
    """Per key: the last row at or before ``latest - offset``, else the first row."""
    row = F.struct(F.col(ts), *[F.col(c) for c in cols])
    latest = df.groupBy(*keys).agg(F.max(ts).alias("_latest"), F.min_by(row, ts).alias("_first"))
    joined = df.join(latest.select(*keys, "_latest"), list(keys)).filter(
        F.col(ts) <= add_seconds("_latest", -offset_hours * 3600))
    found = joined.groupBy(*keys).agg(F.max_by(row, ts).alias("_found"))
    picked = latest.join(found, list(keys), "left").withColumn(
        "_row", F.coalesce("_found", "_first") if fallback == "first" else F.col("_found"))
    return picked.select(*keys, F.col("_latest").alias("latest"), "_row.*")


def next_period(unit: str, c: Column) -> Column:
    return {"day": c + F.expr("interval 1 day"), "week": c + F.expr("interval 7 days"),
            "month": c + F.expr("interval 1 month")}[unit]


def spine_join(counts: DataFrame, keys: Sequence[str], period: str, unit: str,
               cols: Sequence[str]) -> DataFrame:
    """Calendar bins between each key's first and last one; missing bins become 0."""
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[unit]
    bounds = counts.groupBy(*keys).agg(F.min(period).alias("_lo"), F.max(period).alias("_hi"))
    spine = bounds.select(*keys, F.explode(
        F.sequence("_lo", "_hi", F.expr(step))).alias(period))
    return spine.join(counts, [*keys, period], "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in cols})
