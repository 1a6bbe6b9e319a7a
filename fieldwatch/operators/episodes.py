"""Anomaly episodes: characterise, number, age, filter, count."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import flag, present
from ..functions.time import add_seconds, epoch_us, from_us, hours_between, minutes_between, trunc_to
from .hourgrid import spine_join
from .segments import add_runs, hysteresis
from .timeblocks import DAY, running_number

EPISODE_COLUMNS = ["equipment", "type", "severity", "direction", "start", "duration_min",
                   "peak_value", "status", "dimension"]


def characterise_runs(df: DataFrame, run_keys: Sequence[str], ts: str, value: str,
                      bounds: Mapping[str, str | float]) -> DataFrame:
    """One row per run that crosses a mild bound; direction of the larger excursion.

    ``bounds``: mild/extreme lower/upper, as numbers or columns constant within a key.
    Values stay unrounded (round at presentation).
    """
    col = {k: (F.max(v) if isinstance(v, str) else F.lit(float(v))).alias(f"_{k}")
           for k, v in bounds.items()
           if k in ("mild_lower", "mild_upper", "extreme_lower", "extreme_upper")}
    runs = df.groupBy(*run_keys).agg(F.min(ts).alias("start"), F.max(ts).alias("end"),
                                     F.min(value).alias("_min"), F.max(value).alias("_max"),
                                     *[c for c in col.values()])
    up, low = F.col("_max") >= F.col("_mild_upper"), F.col("_min") <= F.col("_mild_lower")
    over = F.col("_max") - F.col("_mild_upper")
    under = F.col("_mild_lower") - F.col("_min")
    high = up & (~low | (over >= under))
    critical = F.when(high, F.col("_max") >= F.col("_extreme_upper")).otherwise(
        F.col("_min") <= F.col("_extreme_lower"))
    minutes = F.greatest(minutes_between("end", "start"), F.lit(K.MIN_EPISODE_MINUTES))
    return runs.filter(up | low).select(
        *run_keys, "start", F.when(high, "high").otherwise("low").alias("direction"),
        F.when(high, F.col("_max")).otherwise(F.col("_min")).alias("peak_value"),
        F.when(critical, "critical").otherwise("alert").alias("severity"),
        minutes.alias("duration_min"))


def age_status(start: str | Column, as_of: str | Column) -> Column:
    hours = hours_between(as_of, start)
    return F.when(hours > K.RESOLVED_AFTER_HOURS, "resolved").when(
        hours > K.ACKNOWLEDGED_AFTER_HOURS, "acknowledged").otherwise("open")


def refresh_status(eps: DataFrame, as_of: str | Column) -> DataFrame:
    return eps.withColumn("status", age_status("start", as_of))


def number_episodes(df: DataFrame, keys: Sequence[str], ts: str = "start",
                    fmt: str = "EP-%04d", ties: Sequence[str] = ()) -> DataFrame:
    """Chronological display ids per key; ``(key, start)`` stays the durable identity."""
    numbered = running_number(df, keys, ts, "_no", ties)
    return numbered.withColumn("id", F.format_string(fmt, F.col("_no"))).drop("_no")


def finish_episodes(runs: DataFrame, keys: Sequence[str], as_of: DataFrame,
                    equipment: Column, kind: str = "collective",
                    dimension: str = "environment") -> DataFrame:
    """Characterised runs -> the episode table; ``as_of``: one ``last_ts`` per key."""
    dated = runs.join(as_of.select(*keys, F.col("last_ts").alias("_as_of")), list(keys))
    eps = dated.select(*keys, "start", "direction", "severity",
                       present(F.col("peak_value"), 2).alias("peak_value"),
                       present(F.col("duration_min"), 1).alias("duration_min"),
                       age_status("start", F.col("_as_of")).alias("status"),
                       equipment.alias("equipment"), F.lit(kind).alias("type"),
                       F.lit(dimension).alias("dimension"))
    return number_episodes(eps, keys).select("id", *keys, *EPISODE_COLUMNS)


def threshold_episodes(segmented: DataFrame, keys: Sequence[str], ts: str, value: str,
                       bounds: DataFrame, as_of: DataFrame, equipment: Column,
                       margin: float = K.HYSTERESIS_MARGIN["temperature"],
                       max_gap: float = K.READING_GAP_SECONDS, direction: str = "high",
                       block_seconds: float = DAY) -> DataFrame:
    """Model-free detector: hysteresis on the mild bound, then the usual characterisation.

    ``bounds``: one Tukey row per key.  It is small and joined by key; adaptive execution
    broadcasts it when its measured size allows and splits hot keys otherwise.
    """
    names = ["mild_lower", "mild_upper", "extreme_lower", "extreme_upper"]
    rows = segmented.join(bounds.select(*keys, *names), list(keys))
    sign, edge = (-1, "mild_upper") if direction == "high" else (1, "mild_lower")
    rows = rows.withColumn("_exit", F.col(edge) + F.lit(sign * margin))
    marked = hysteresis(rows, keys, ts, value, edge, "_exit", direction, max_gap=max_gap,
                        block_seconds=block_seconds).filter(F.col("episode_id") > 0)
    runs = characterise_runs(marked, [*keys, "episode_id"], ts, value, {n: n for n in names})
    return finish_episodes(runs, keys, as_of, equipment)


def state_episodes(decoded: DataFrame, keys: Sequence[str], ts: str, value: str,
                   bounds: Mapping[str, str | float], as_of: DataFrame, equipment: Column,
                   flag_col: str = "is_anomaly", segment: str = "segment_id",
                   block_seconds: float = DAY) -> DataFrame:
    """Decoded rows -> contiguous anomalous runs -> episodes (the model-based detector)."""
    runs = add_runs(decoded, keys, ts, flag_col, segment, block_seconds).filter(F.col(flag_col))
    found = characterise_runs(runs, [*keys, "run_id"], ts, value, bounds)
    return finish_episodes(found, keys, as_of, equipment)


def apply_overrides(eps: DataFrame, actions: DataFrame, on: Sequence[str] = ("id",)) -> DataFrame:
    """The latest user status wins over the computed one."""
    over = actions.select(*on, F.col("status").alias("_user"))
    return (eps.join(over, list(on), "left")
               .withColumn("status", F.coalesce("_user", "status")).drop("_user"))


def _count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(flag(F.coalesce(condition, F.lit(False)))), F.lit(0))


def _tallies(cols: Mapping[str, Sequence[str]], within: Column | None = None) -> list[Column]:
    keep = F.lit(True) if within is None else within
    return [_count_if(keep & (F.col(c) == v)).alias(f"{c}_{v}") for c, vs in cols.items() for v in vs]


EPISODE_VALUES = {"type": ["collective", "duration", "sequence"], "severity": K.SEVERITIES,
                  "direction": K.DIRECTIONS, "status": K.STATUSES}


def episode_stats(eps: DataFrame, window_days: Column | int, keys: Sequence[str] = ()) -> DataFrame:
    """Totals, tallies by value (zeros included), busiest equipment, MTBA and time share.

    Episodes are first reduced per ``(key, equipment)``, so one busy key costs no more than
    its list of equipment.
    """
    per = eps.groupBy(*keys, "equipment").agg(
        F.count(F.lit(1)).alias("_n"), F.min("start").alias("_lo"), F.max("start").alias("_hi"),
        F.sum("duration_min").alias("_min"), *_tallies(EPISODE_VALUES))
    names = [f"{c}_{v}" for c, vs in EPISODE_VALUES.items() for v in vs]
    best = F.min_by(F.struct("equipment", "_n"), F.struct(-F.col("_n"), F.col("equipment")))
    out = per.groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total"), F.min("_lo").alias("_lo"),
        F.max("_hi").alias("_hi"), F.coalesce(F.sum("_min"), F.lit(0.0)).alias("_min"),
        best.alias("_best"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    days = window_days if isinstance(window_days, Column) else F.lit(window_days)
    minutes = F.greatest(days * 24 * 60, F.lit(1))
    mtba = F.when(F.col("total") > 1, hours_between("_hi", "_lo") / (F.col("total") - 1)).otherwise(0.0)
    return out.select(*keys, "total", present(100 * F.col("_min") / minutes, 2).alias("anomaly_rate_pct"),
                      present(mtba, 1).alias("mtba_hours"), *names,
                      F.col("_best.equipment").alias("top_equipment"),
                      F.coalesce(F.col("_best._n"), F.lit(0)).alias("top_equipment_count"))


def episode_histogram(eps: DataFrame, bucket: str, keys: Sequence[str] = ()) -> DataFrame:
    """Episodes per day, Monday week or month and severity; empty bins included."""
    period = F.to_date(trunc_to(bucket, "start"))
    counts = eps.groupBy(*keys, period.alias("period_start")).agg(
        F.count(F.lit(1)).alias("total"), *_tallies({"severity": K.SEVERITIES}))
    return spine_join(counts, keys, "period_start", bucket,
                      ["total", *[f"severity_{s}" for s in K.SEVERITIES]])


def window_stats(eps: DataFrame, window_hours: int, as_of: DataFrame, dim: DataFrame | None,
                 keys: Sequence[str], dimensions: Sequence[str] = ("environment", "scada")) -> DataFrame:
    """Trailing-window KPIs per key ending at ``as_of.last_ts`` (keys without episodes too).

    The window is closed at both ends, the preceding one half-open.
    """
    from .cleaning import with_family
    rows = eps if dim is None else with_family(eps, dim, "equipment")
    ref = as_of.select(*keys, F.col("last_ts").alias("reference_at"))
    rows = rows.join(ref, list(keys)).filter(
        (F.col("start") <= F.col("reference_at"))
        & (F.col("start") >= add_seconds("reference_at", -2 * window_hours * 3600.0)))
    current = F.col("start") >= add_seconds("reference_at", -window_hours * 3600.0)
    per = rows.groupBy(*keys, "family").agg(
        _count_if(current).alias("_n"), _count_if(~current).alias("_p"),
        F.coalesce(F.sum(F.when(current, F.col("duration_min"))), F.lit(0.0)).alias("_min"),
        *_tallies({"dimension": dimensions}, current))
    seen = F.col("_n") > 0
    best = F.min_by(F.when(seen, F.struct("family", "_n")),
                    F.when(seen, F.struct(-F.col("_n"), F.col("family"))))
    tallies = [f"dimension_{d}" for d in dimensions]
    out = per.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.sum("_p").alias("_p"),
                                 F.sum("_min").alias("_min"), best.alias("_best"),
                                 *[F.sum(t).alias(t) for t in tallies])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return ref.join(out, list(keys), "left").select(
        *keys, "reference_at", zero("_n").alias("total"), zero("_p").alias("previous_total"),
        present(100 * F.coalesce(F.col("_min"), F.lit(0.0)) / (window_hours * 60), 2).alias("rate_pct"),
        F.col("_best.family").alias("top_family"),
        F.coalesce(F.col("_best._n"), F.lit(0)).alias("top_family_count"),
        *[zero(t).alias(t) for t in tallies])


def shift_time(df: DataFrame, cols: Sequence[str], delta_seconds: Column | float,
               clamp: Mapping[str, Column] | None = None) -> DataFrame:
    """Move every listed time by one delta; ``clamp``: column -> latest allowed value."""
    df = df.withColumns({c: add_seconds(c, delta_seconds) for c in cols})
    return df.withColumns({c: F.least(F.col(c), top) for c, top in (clamp or {}).items()})


def anchor_delta(now: Column, anchor: str | Column) -> Column:
    """Seconds that bring ``anchor`` to ``now`` floored to the hour."""
    return (epoch_us(trunc_to("hour", now)) - epoch_us(anchor)) / F.lit(1e6)
