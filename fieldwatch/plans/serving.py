"""Serving queries over gold tables (Q1-Q10, J8, T5): every one returns a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import present
from ..operators.cleaning import filter_episodes
from ..operators.episodes import apply_overrides, episode_histogram, episode_stats, window_stats
from ..operators.hourgrid import HOUR, asof_backward, asof_nearest, daily_history
from ..operators.maintenance import (latest_actions, pm_calendar, reminders, threshold_reminders,
                                     visible_reminders)
from ..operators.scoring import api_status, latest_row

DOMAINS = {"environment": "environmental_health_score", "energy": "energy_health_score",
           "battery": "battery_health_score"}
HISTORY_DAYS = {"7d": 7, "30d": 30, "90d": 90}
WINDOW_HOURS = {"24h": 24, "7d": 168}
DRIVERS = {"Environmental": "environment", "Energy": "energy", "Battery": "battery"}


def overview(hourly: DataFrame, meta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: global and domain scores now and 24 h earlier, status, time shift."""
    scores = {"global": "overall_site_health", **DOMAINS}
    earlier = asof_backward(hourly, keys, HOUR, 24, list(scores.values())).select(
        *keys, *[F.col(c).alias(f"_p_{n}") for n, c in scores.items()])
    now = latest_row(hourly.select(*keys, HOUR, *scores.values()), keys)
    rows = now.join(earlier, list(keys)).join(meta.select(*keys, "shift_days"), list(keys), "left")
    out = rows.select(*keys, F.col(HOUR).alias("updated_at"), "shift_days", F.explode(F.array(*[
        F.struct(F.lit(n).alias("domain"), present(F.col(c), 1).alias("score"),
                 present(F.col(f"_p_{n}"), 1).alias("previous_score"))
        for n, c in scores.items()])).alias("r"))
    return out.select(*keys, "updated_at", "shift_days", "r.*").withColumn(
        "status", api_status(F.col("score")))


def history(hourly: DataFrame, keys: Sequence[str], range_: str = "30d") -> DataFrame:
    cols = {"global_score": "overall_site_health", **DOMAINS}
    return daily_history(hourly, keys, HISTORY_DAYS[range_], cols)


def first_crossing(points: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Earliest forecast point whose lower band lies below the threshold."""
    return points.filter("is_forecast").filter(F.col("lower") < threshold).groupBy(*keys).agg(
        F.min("timestamp").alias("timestamp")).withColumn("threshold", F.lit(float(threshold)))


def crossings(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First crossings of the watch and critical levels, unless already below at the anchor."""
    observed = F.when(~F.col("is_forecast"), F.col("timestamp"))
    anchor = F.coalesce(F.max_by("value", observed), F.lit(100.0))
    below = lambda t: F.min(F.when(F.col("is_forecast") & (F.col("lower") < t), F.col("timestamp")))
    one = points.groupBy(*keys).agg(anchor.alias("_anchor"), below(K.HEALTHY_MIN).alias("_w"),
                                    below(K.WATCH_MIN).alias("_c"))
    entry = lambda at, t, s: F.struct(
        F.when(F.col("_anchor") >= t, F.col(at)).alias("timestamp"), F.lit(t).alias("threshold"),
        F.lit(s).alias("severity"))
    rows = one.select(*keys, F.explode(F.array(entry("_w", K.HEALTHY_MIN, "watch"),
                                               entry("_c", K.WATCH_MIN, "critical"))).alias("x"))
    return rows.select(*keys, "x.*").filter(F.col("timestamp").isNotNull())


def forecast(points: DataFrame, horizon: str) -> DataFrame:
    return points.filter(F.col("horizon") == horizon)


def predicted_faults(hourly: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and domain; only the current main driver gets the crossing's date."""
    level = F.when(F.col("severity") == "critical", 1).otherwise(0)
    first = crossings(points, keys).groupBy(*keys).agg(
        F.min_by(F.struct("timestamp", "severity"), F.struct(F.col("timestamp"), level)).alias("_x"))
    now = latest_row(hourly.select(*keys, HOUR, "main_risk_driver", *DOMAINS.values()), keys)
    rows = now.join(first, list(keys), "left").select(
        *keys, "main_risk_driver", "_x", F.explode(F.array(*[F.struct(
            F.lit(d).alias("domain"), F.lit(n).alias("driver"),
            present(F.col(DOMAINS[d]), 1).alias("score")) for n, d in DRIVERS.items()])).alias("r"))
    mine = (F.col("r.driver") == F.col("main_risk_driver")) & F.col("_x").isNotNull()
    return rows.select(
        *keys, "r.domain", "r.score", F.when(mine, F.col("_x.timestamp")).alias("predicted_at"),
        F.when(mine, F.when(F.col("_x.severity") == "critical", "critical").otherwise("alert"))
        .alias("severity"))


attribute_crossing = predicted_faults


def subscore_forecast(hourly: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Domain histories (nearest hour within 12 h), then flat with the global band's widths."""
    past = points.filter(~F.col("is_forecast")).select(*keys, "timestamp")
    seen = asof_nearest(past, hourly.select(*keys, F.col(HOUR).alias("timestamp"), *DOMAINS.values()),
                        keys, "timestamp", 12 * 3600, list(DOMAINS.values()))
    per_domain = lambda make: F.explode(F.array(*[make(d, c) for d, c in DOMAINS.items()]))
    done = seen.select(*keys, "timestamp", per_domain(lambda d, c: F.struct(
        F.lit(d).alias("domain"), F.col(c).alias("v"))).alias("r")).filter(
        F.col("r.v").isNotNull()).select(
        *keys, "timestamp", "r.domain", present(F.col("r.v"), 1).alias("value"),
        present(F.col("r.v"), 1).alias("lower"), present(F.col("r.v"), 1).alias("upper"),
        F.lit(False).alias("is_forecast"))
    now = latest_row(hourly.select(*keys, HOUR, *DOMAINS.values()), keys).drop(HOUR)
    ahead = points.filter("is_forecast").select(*keys, "timestamp", "value", "lower", "upper").join(
        now, list(keys))
    below, above = F.col("value") - F.col("lower"), F.col("upper") - F.col("value")
    flat = ahead.select(*keys, "timestamp", per_domain(lambda d, c: F.struct(
        F.lit(d).alias("domain"), present(F.col(c), 1).alias("value"),
        present(F.greatest(F.lit(0.0), F.col(c) - below), 1).alias("lower"),
        present(F.least(F.lit(100.0), F.col(c) + above), 1).alias("upper"))).alias("r")).select(
        *keys, "timestamp", "r.*", F.lit(True).alias("is_forecast"))
    return done.unionByName(flat)


def list_episodes(eps: DataFrame, actions: DataFrame, on: Sequence[str] = ("id",),
                  newest_first: bool = False, **filters) -> DataFrame:
    out = filter_episodes(apply_overrides(eps, actions, on), **filters)
    return out.orderBy(F.col("start").desc()) if newest_first else out


def stats(eps: DataFrame, span_days: Column | int, keys: Sequence[str] = ()) -> DataFrame:
    return episode_stats(eps, span_days, keys)


def histogram(eps: DataFrame, bucket: str, keys: Sequence[str] = ()) -> DataFrame:
    return episode_histogram(eps, bucket, keys)


def window_kpis(eps: DataFrame, window: str, as_of: DataFrame, dim: DataFrame | None,
                keys: Sequence[str]) -> DataFrame:
    return window_stats(eps, WINDOW_HOURS[window], as_of, dim, keys)


def set_status(requests: DataFrame, eps: DataFrame, on: Sequence[str] = ("id",)) -> DataFrame:
    """Status requests -> the updated episodes; unknown ids and statuses drop out."""
    valid = requests.filter(F.col("status").isin(K.STATUSES))
    newest = valid.groupBy(*on).agg(F.max_by("status", "updated_at").alias("status"))
    return apply_overrides(eps.join(newest, list(on), "left_semi"), newest, on)


def active_reminders(calendar: DataFrame, eps: DataFrame, log: DataFrame, as_of: str,
                     points: DataFrame | None = None, bounds: DataFrame | None = None,
                     keys: Sequence[str] = ()) -> DataFrame:
    rows = reminders(calendar, eps, keys)
    if points is not None:
        rows = rows.unionByName(threshold_reminders(points, keys, K.HEALTHY_MIN, bounds))
    return visible_reminders(rows, latest_actions(log), as_of)


def reminder_count(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def equipment(dim: DataFrame, unit: str = "equipment") -> DataFrame:
    return dim.select(unit).distinct()


def calendar(schedule: DataFrame, as_of: str) -> DataFrame:
    return pm_calendar(schedule, as_of)


def next_fault(faults: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The soonest dated predicted fault per key."""
    row = F.struct("domain", "predicted_at", "severity")
    return faults.filter(F.col("predicted_at").isNotNull()).groupBy(*keys).agg(
        F.min_by(row, F.struct("predicted_at", "domain")).alias("_r")).select(*keys, "_r.*")
