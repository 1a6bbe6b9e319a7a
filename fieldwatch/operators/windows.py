"""Rolling features.

W1-W3 run on raw readings inside segments: bounded look-back, so ``(key, block)`` tasks with
a halo.  The others run on the hourly grid, where one key is bounded by its hours; all
expressions of one key share a single shuffle and sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import clip, finite, flag
from ..functions.time import hour_index
from .timeblocks import BLOCK, DAY, HALO, US, block_window, drop_helpers, with_halo


# --- raw readings, inside segments ----------------------------------------------------
def _rolling_columns(frame_of, cols: Sequence[str], windows: Mapping[str, tuple[int, int]],
                     ddof: int) -> dict[str, Column]:
    spread = F.stddev_pop if ddof == 0 else F.stddev_samp
    out = {}
    for c in cols:
        for name, (n, least) in windows.items():
            w = frame_of(n)
            enough = F.count(c).over(w) >= least
            out[f"{c}_mean_{name}"] = F.when(enough, F.avg(c).over(w))
            out[f"{c}_std_{name}"] = F.when(enough, spread(c).over(w))
    return out


def rolling_stats(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
                  windows: Mapping[str, tuple[int, int]] = K.ROLLING_WINDOWS, ddof: int = 0,
                  segment: str = "segment_id", max_gap: float = K.READING_GAP_SECONDS,
                  block_seconds: float = DAY) -> DataFrame:
    reach = max_gap * (max(n for n, _ in windows.values()) - 1)
    framed = with_halo(df, ts, reach, block_seconds)
    w = block_window(keys, segment)
    rolled = framed.withColumns(_rolling_columns(
        lambda n: w.rowsBetween(-(n - 1), 0), cols, windows, ddof))
    return drop_helpers(rolled.filter(~F.col(HALO)))


def freshness(df: DataFrame, position: str = "segment_position",
              windows: Mapping[str, tuple[int, int]] = K.ROLLING_WINDOWS) -> DataFrame:
    return df.withColumns({
        f"freshness_{name}": F.least(F.col(position) / F.lit(float(max(n - 1, 1))), F.lit(1.0))
        for name, (n, _) in windows.items()})


def changes(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
            lags: Sequence[int] = (1, 5), segment: str = "segment_id",
            max_gap: float = K.READING_GAP_SECONDS, block_seconds: float = DAY) -> DataFrame:
    framed = with_halo(df, ts, max_gap * max(lags), block_seconds)
    w = block_window(keys, segment)
    out = framed.withColumns({f"{c}_change_{n}": F.col(c) - F.lag(c, n).over(w)
                              for c in cols for n in lags})
    return drop_helpers(out.filter(~F.col(HALO)))


def state_features(df: DataFrame, keys: Sequence[str], ts: str,
                   windows: Mapping[str, tuple[int, int]] = K.ROLLING_WINDOWS,
                   segment: str = "segment_id", position: str = "segment_position",
                   max_gap: float = K.READING_GAP_SECONDS,
                   block_seconds: float = DAY) -> DataFrame:
    """W1-W3 together: the 19 model features of each reading in one shuffle and one sort."""
    cols = ["temperature", "humidity"]
    framed = with_halo(df, ts, max_gap * (max(n for n, _ in windows.values()) - 1), block_seconds)
    w = block_window(keys, segment)
    wide = framed.withColumns({
        **_rolling_columns(lambda n: w.rowsBetween(-(n - 1), 0), cols, windows, 0),
        **{f"{c}_change_{n}": F.col(c) - F.lag(c, n).over(w) for c in cols for n in (1, 5)}})
    wide = drop_helpers(wide.filter(~F.col(HALO)))
    return freshness(wide, position, windows).withColumns({
        f"{c}_short_long": F.col(f"{c}_mean_short") - F.col(f"{c}_mean_long") for c in cols})


# --- hourly grid ----------------------------------------------------------------------
def _order(keys: Sequence[str], ts: str):
    return W.partitionBy(*keys).orderBy(ts)


def _last(keys: Sequence[str], ts: str, n: int):
    return _order(keys, ts).rowsBetween(-(n - 1), 0)


def zscore_burden(df: DataFrame, keys: Sequence[str], ts: str,
                  cols: Mapping[str, str], n: int = 24, least: int = 6,
                  z: float = 3.0) -> DataFrame:
    """24 h z-scores, anomaly flag, its ratio and severity, and the anomaly burden.

    ``cols``: column -> prefix of its z-score and severity.
    """
    w = _last(keys, ts, n)
    scores, severe, hits = {}, {}, F.lit(False)
    for c, name in cols.items():
        spread = F.stddev_samp(c).over(w)
        ok = (F.count(c).over(w) >= least) & (spread != 0)
        scores[f"{name}_zscore"] = F.coalesce(
            finite(F.when(ok, (F.col(c) - F.avg(c).over(w)) / spread)), F.lit(0.0))
        hits = hits | (F.abs(F.col(f"{name}_zscore")) >= z)
        severe[f"{name}_anomaly_severity"] = clip((F.abs(F.col(f"{name}_zscore")) - z) / z, 0.0, 1.0)
    df = df.withColumns(scores).withColumns({**severe, "environmental_anomaly_flag": flag(hits)})
    worst = F.greatest(*severe) if len(severe) > 1 else F.col(next(iter(severe)))
    return (df.withColumn("_worst", worst)
              .withColumn("environmental_anomaly_ratio",
                          F.avg("environmental_anomaly_flag").over(w))
              .withColumn("environmental_anomaly_severity", F.avg("_worst").over(w))
              .withColumn("environmental_anomaly_burden", clip(
                  0.60 * F.col("environmental_anomaly_ratio")
                  + 0.40 * F.col("environmental_anomaly_severity"), 0.0, 1.0)).drop("_worst"))


def trend_volatility(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
                     smooth: Sequence[str] = ()) -> DataFrame:
    w, day = _order(keys, ts), _last(keys, ts, 24)
    out = {}
    for c in cols:
        out[f"{c}_trend_6h"] = F.col(c) - F.lag(c, 6).over(w)
        out[f"{c}_trend_24h"] = F.col(c) - F.lag(c, 24).over(w)
        out[f"{c}_volatility_24h"] = F.when(F.count(c).over(day) >= 6, F.stddev_samp(c).over(day))
    for c in smooth:
        out[f"{c}_smoothed"] = F.avg(c).over(_last(keys, ts, 6))
        out[f"{c}_smoothed_6h"] = out[f"{c}_smoothed"]
    return df.withColumns(out)


def _full(c: str, w, n: int, value: Column) -> Column:
    return F.when(F.count(c).over(w) >= n, value)


def slope_column(keys: Sequence[str], ts: str, c: str, n: int, index: str = "_i") -> Column:
    w = _last(keys, ts, n)
    return _full(c, w, n, F.regr_slope(F.col(c), F.col(index).cast("double")).over(w))


def rolling_slope(df: DataFrame, keys: Sequence[str], ts: str, col: str, n: int) -> DataFrame:
    """Least-squares slope per row over the last ``n`` rows; full windows only."""
    numbered = df.withColumn("_i", F.row_number().over(_order(keys, ts)))
    return numbered.withColumn(f"{col}_slope_{n}h", slope_column(keys, ts, col, n)).drop("_i")


def acceleration_column(keys: Sequence[str], ts: str, c: str, p: int) -> Column:
    w = _order(keys, ts)
    return F.col(c) - 2 * F.lag(c, p).over(w) + F.lag(c, 2 * p).over(w)


def acceleration(df: DataFrame, keys: Sequence[str], ts: str, col: str, p: int) -> DataFrame:
    return df.withColumn(f"{col}_accel_{p}h", acceleration_column(keys, ts, col, p))


def trajectory_columns(keys: Sequence[str], ts: str, c: str) -> dict[str, Column]:
    """The 44 trajectory features of one variable (they need the row index ``_i``)."""
    w, x, out = _order(keys, ts), F.col(c), {}
    diff = lambda p: x - F.lag(c, p).over(w)
    for n in K.TRAJECTORY_LAGS:
        out[f"{c}_lag_{n}h"] = F.lag(c, n).over(w)
    for n in K.TRAJECTORY_CHANGES:
        out[f"{c}_change_{n}h"] = diff(n)
    for n in K.TRAJECTORY_RATES:
        out[f"{c}_rate_{n}h"] = diff(n) / F.lit(float(n))
    for n in K.TRAJECTORY_WINDOWS:
        f = _last(keys, ts, n)
        low, high = _full(c, f, n, F.min(c).over(f)), _full(c, f, n, F.max(c).over(f))
        out[f"{c}_rollmean_{n}h"] = _full(c, f, n, F.avg(c).over(f))
        out[f"{c}_rollstd_{n}h"] = _full(c, f, n, F.stddev_samp(c).over(f))
        out[f"{c}_rollmin_{n}h"], out[f"{c}_rollmax_{n}h"] = low, high
        out[f"{c}_rollrange_{n}h"] = high - low
    for n in K.TRAJECTORY_SLOPES:
        out[f"{c}_slope_{n}h"] = slope_column(keys, ts, c, n)
    for n in K.TRAJECTORY_ACCELERATIONS:
        out[f"{c}_accel_{n}h"] = acceleration_column(keys, ts, c, n)
    return out


def trajectory(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    numbered = df.withColumn("_i", F.row_number().over(_order(keys, ts)))
    wide = {n: e for c in cols for n, e in trajectory_columns(keys, ts, c).items()}
    return numbered.withColumns(wide).drop("_i")


def base_columns(keys: Sequence[str], ts: str,
                 health: str = "overall_site_health") -> dict[str, Column]:
    w, x, out = _order(keys, ts), F.col(health), {}
    for n in K.HEALTH_LAGS:
        out[f"overall_health_lag_{n}h"] = F.lag(health, n).over(w)
    for n in K.HEALTH_WINDOWS:
        f = _last(keys, ts, n)
        out[f"health_mean_{n}h"] = _full(health, f, n, F.avg(health).over(f))
        out[f"health_std_{n}h"] = _full(health, f, n, F.stddev_samp(health).over(f))
        out[f"health_min_{n}h"] = _full(health, f, n, F.min(health).over(f))
    for c in K.SUBSYSTEM_HEALTH:
        for n in K.SUBSYSTEM_LAGS:
            out[f"{c}_lag_{n}h"] = F.lag(c, n).over(w)
    for n in K.HEALTH_CHANGES:
        out[f"overall_health_change_{n}h"] = x - F.lag(health, n).over(w)
    return out


def base_features(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    return df.withColumns(base_columns(keys, ts))


def targets(df: DataFrame, keys: Sequence[str], ts: str, col: str = "overall_site_health",
            h: int = K.HORIZON_ROWS) -> DataFrame:
    """Value ``h`` rows ahead, its change, and 0/1 major and severe drop labels."""
    ahead = F.lead(col, h).over(_order(keys, ts))
    df = df.withColumn("target_health_6h", ahead)
    change = F.col("target_health_6h") - F.col(col)
    known = change.isNotNull()
    return df.withColumns({
        "target_health_change_6h": change, "health_change_6h": change,
        "major_drop_6h": F.when(known, flag(change <= K.MAJOR_DROP)),
        "severe_drop_6h": F.when(known, flag(change <= K.SEVERE_DROP))})


def decayed_sums(df: DataFrame, keys: Sequence[str], ts: str, cols: Mapping[str, str],
                 half_life: float, block_hours: int = 240) -> DataFrame:
    """Recency-weighted running totals ``S = d S' + x`` on the dense hourly grid, over all earlier hours.

    Blocks of ``block_hours`` hours; inside a block a scaled prefix sum. Between blocks each block is one
    summary row, its worth at its last hour slot, and a block starts from all earlier ones, each decayed
    by its distance. ``cols``: output name -> input column.
    """
    d = 0.5 ** (1.0 / half_life)
    hour = hour_index(ts)
    block = F.floor(hour / F.lit(float(block_hours))).cast("bigint")
    df = df.withColumn("_hb", block).withColumn("_o", (hour - block * block_hours).cast("double"))
    w = W.partitionBy(*keys, "_hb").orderBy("_o").rowsBetween(W.unboundedPreceding, 0)
    up, down = F.pow(F.lit(d), -F.col("_o")), F.pow(F.lit(d), F.col("_o"))
    ends = F.pow(F.lit(d), F.lit(float(block_hours - 1)) - F.col("_o"))
    worth = {n: F.coalesce(F.col(c), F.lit(0)) * ends for n, c in cols.items()}
    blocks = df.groupBy(*keys, "_hb").agg(*[F.sum(e).alias(f"_w_{n}") for n, e in worth.items()])
    earlier = W.partitionBy(*keys).orderBy("_hb").rowsBetween(W.unboundedPreceding, -1)
    step = F.lit(d ** block_hours)

    def carried(n: str) -> Column:
        """All earlier blocks, one number each, decayed up to the hour before this block."""
        past = F.collect_list(F.struct("_hb", f"_w_{n}")).over(earlier)
        return F.aggregate(past, F.lit(0.0), lambda total, b: total + b[f"_w_{n}"] * F.pow(step, F.col("_hb") - b["_hb"] - 1))
    blocks = blocks.select(*keys, "_hb", *[carried(n).alias(f"_c_{n}") for n in cols])
    df = df.withColumns({f"_l_{n}": down * F.sum(F.coalesce(F.col(c), F.lit(0)) * up).over(w) for n, c in cols.items()})
    df = df.join(blocks, [*keys, "_hb"])
    return df.withColumns({n: F.col(f"_l_{n}") + F.col(f"_c_{n}") * F.lit(d) * down for n in cols}).drop(
        "_hb", "_o", *[f"_{k}_{n}" for k in "lc" for n in cols])


def chrono_split(df: DataFrame, keys: Sequence[str], ts: str, train: float = 0.70,
                 validation: float = 0.85, by: str = "row") -> DataFrame:
    """``split`` = train / validation / test in time order, by rows or by distinct days."""
    if by == "row":
        n = F.count(F.lit(1)).over(W.partitionBy(*keys))
        rank = F.row_number().over(_order(keys, ts))
        ranked = df.withColumn("_n", n).withColumn("_rk", rank)
    else:
        day = F.to_date(ts)
        days = df.select(*keys, day.alias("_day")).distinct()
        days = days.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys))).withColumn(
            "_rk", F.row_number().over(W.partitionBy(*keys).orderBy("_day")))
        ranked = df.withColumn("_day", day).join(days, [*keys, "_day"])
    cut = lambda p: F.floor(F.col("_n") * F.lit(p))
    label = F.when(F.col("_rk") <= cut(train), "train").when(
        F.col("_rk") <= cut(validation), "validation").otherwise("test")
    return ranked.withColumn("split", label).drop("_n", "_rk", "_day")


def cross_features(df: DataFrame) -> DataFrame:
    c = F.col
    risks = [c(x) for x in K.SUBSYSTEM_RISK]
    healths = [c(x) for x in K.SUBSYSTEM_HEALTH]
    below = lambda x: sum((flag(F.coalesce(h < x, F.lit(False))) for h in healths), F.lit(0))
    return df.withColumns({
        "interaction_energy_battery_risk": c("energy_risk_score") * c("battery_risk_score"),
        "interaction_environmental_energy_risk":
            c("environmental_risk_score") * c("energy_risk_score"),
        "interaction_environmental_battery_risk":
            c("environmental_risk_score") * c("battery_risk_score"),
        "interaction_energy_battery_anomaly_burden":
            c("energy_anomaly_burden") * c("battery_anomaly_burden"),
        "max_subsystem_risk": F.greatest(*risks),
        "min_subsystem_health": F.least(*healths),
        "subsystem_health_spread": F.greatest(*healths) - F.least(*healths),
        "subsystems_below_80": below(80), "subsystems_below_60": below(60)})


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    import math
    df = df.withColumns({"hour": F.hour(ts), "day_of_week": F.weekday(ts), "month": F.month(ts)})
    angle = lambda c, n: F.lit(2 * math.pi) * F.col(c) / F.lit(float(n))
    return df.withColumns({
        "is_weekend": flag(F.col("day_of_week") >= 5),
        "hour_sin": F.sin(angle("hour", 24)), "hour_cos": F.cos(angle("hour", 24)),
        "day_of_week_sin": F.sin(angle("day_of_week", 7)),
        "day_of_week_cos": F.cos(angle("day_of_week", 7))})
