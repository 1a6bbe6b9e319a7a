"""Maintenance calendar and reminders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.time import add_seconds


def next_pm(last: str | Column, value: str | Column, unit: str | Column) -> Column:
    """Last date plus a period in days, weeks or months (clamped to the month's end)."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    last, value, unit = c(last), c(value).cast("int"), c(unit)
    return (F.when(unit == "days", F.date_add(last, value))
             .when(unit == "weeks", F.date_add(last, value * 7))
             .when(unit == "months", F.add_months(last, value)))


def pm_calendar(schedule: DataFrame, as_of: str | Column) -> DataFrame:
    """Days remaining against ``as_of`` and urgency, for schedules with a positive period."""
    ref = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    due = schedule.withColumn("next_pm_date", next_pm("last_pm_date", "period_value", "period_unit"))
    due = due.withColumn("days_remaining", F.datediff("next_pm_date", ref))
    left = F.col("days_remaining")
    return due.withColumn("urgency", F.when(left < 0, "overdue").when(left <= 7, "soon")
                          .otherwise("later"))


def maintenance_kpi(calendar: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Most urgent entry and the number due within 0..7 days."""
    row = F.struct("id", "equipment", "next_pm_date", "days_remaining")
    return calendar.groupBy(*keys).agg(
        F.min_by(row, F.struct("days_remaining", "id")).alias("_n"),
        F.coalesce(F.sum(F.col("days_remaining").between(0, 7).cast("int")), F.lit(0))
        .alias("due_this_week")).select(
        *keys, F.col("_n.id").alias("next_id"), F.col("_n.equipment").alias("next_equipment"),
        F.col("_n.days_remaining").alias("next_days_remaining"), "due_this_week")


def current_schedule(log: DataFrame, row_id: str = "pm_id", version: str = "version",
                     op: str = "op", cols: Sequence[str] = (
                         "equipment", "last_pm_date", "period_value", "period_unit")) -> DataFrame:
    """Current entries of a change log of ``schedule`` / ``update`` / ``delete`` rows.

    An update or delete of an id never scheduled, or already deleted, has no effect.
    Versions of one id are combined map-side; the log of one id is never gathered.
    """
    at = lambda cond: F.when(cond, F.col(version))
    made, gone = F.col(op) == "schedule", F.col(op) == "delete"
    life = log.groupBy(row_id).agg(
        F.max(at(made)).alias("_made"), F.max(at(gone)).alias("_gone"),
        # never older than the latest scheduling, which is one of these versions itself
        F.max_by(F.struct(*[F.col(c) for c in cols]), at(~gone)).alias("_s"))
    alive = F.col("_made").isNotNull() & (F.col("_gone").isNull() | (F.col("_gone") < F.col("_made")))
    return life.filter(alive).select(
        F.format_string("PM-%04d", F.col(row_id)).alias("id"), *[f"_s.{c}" for c in cols])


def parse_id(c: str | Column, prefix: str = "PM") -> Column:
    """``PM-0004`` -> 4; NULL for anything else."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(rf"^{prefix}-[0-9]+$"),
                  F.regexp_extract(c, r"-([0-9]+)$", 1).try_cast("bigint"))


def pm_reminders(calendar: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    left = F.col("days_remaining")
    due = calendar.filter(left <= K.PM_REMINDER_DAYS)
    text = F.when(left < 0, F.format_string("Maintenance overdue by %d d for %s", -left, F.col("equipment"))) \
            .otherwise(F.format_string("Maintenance due in %d d for %s", left, F.col("equipment")))
    return due.select(*keys, F.concat(F.lit("RM-PM-"), F.col("id")).alias("id"),
                      F.lit("upcoming_pm").alias("kind"), "equipment", text.alias("message"),
                      F.col("next_pm_date").cast("timestamp_ntz").alias("due_at"),
                      F.when(left < 0, "warning").otherwise("info").alias("severity"))


def anomaly_reminders(eps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    text = F.concat(F.lit("Unacknowledged "), F.col("severity"), F.lit(" anomaly on "),
                    F.col("equipment"))
    return eps.filter(F.col("status") == "open").select(
        *keys, F.concat(F.lit("RM-AN-"), F.col("id")).alias("id"),
        F.lit("unacked_anomaly").alias("kind"), "equipment", text.alias("message"),
        F.col("start").alias("due_at"),
        F.when(F.col("severity") == "critical", "critical").otherwise("warning").alias("severity"))


def reminders(calendar: DataFrame, eps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return pm_reminders(calendar, keys).unionByName(anomaly_reminders(eps, keys))


def threshold_reminders(points: DataFrame, keys: Sequence[str], threshold: float,
                        as_of: DataFrame, hours: float = 24) -> DataFrame:
    """First forecast point within ``hours`` whose lower band falls below the threshold."""
    ref = as_of.select(*keys, F.col("last_ts").alias("_as_of"))
    near = points.filter("is_forecast").join(ref, list(keys)).filter(
        (F.col("timestamp") <= add_seconds("_as_of", hours * 3600))
        & (F.col("lower") < threshold))
    return near.groupBy(*keys).agg(F.min("timestamp").alias("due_at")).select(
        *keys, F.concat_ws("-", F.lit("RM-TH"), *[F.col(k).cast("string") for k in keys]).alias("id"),
        F.lit("threshold_approach").alias("kind"), F.lit("site").alias("equipment"),
        F.lit(f"Forecast falls below {threshold:g} within {hours:g} h").alias("message"),
        "due_at", F.lit("warning").alias("severity"))


def valid_snooze(log: DataFrame) -> DataFrame:
    """Actions whose snooze length, where given, lies in (0, 720] hours."""
    h = F.col("snooze_hours")
    return log.filter(h.isNull() | ((h > 0) & (h <= K.SNOOZE_MAX_HOURS)))


def latest_actions(log: DataFrame, key: str = "reminder_id", at: str = "updated_at") -> DataFrame:
    """State per reminder: acknowledged once is for good, the latest snooze counts."""
    return valid_snooze(log).groupBy(key).agg(
        F.max("acknowledged").alias("acknowledged"), F.max(at).alias("updated_at"),
        F.max_by(add_seconds(at, F.col("snooze_hours") * 3600.0),
                 F.when(F.col("snooze_hours").isNotNull(), F.col(at))).alias("snoozed_until"))


def visible_reminders(rem: DataFrame, actions: DataFrame, as_of: str | Column,
                      key: str = "reminder_id") -> DataFrame:
    ref = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    hidden = actions.filter(F.coalesce(F.col("acknowledged"), F.lit(False))
                            | (F.col("snoozed_until") > ref))
    return rem.join(hidden.select(F.col(key).alias("id")), "id", "left_anti")
