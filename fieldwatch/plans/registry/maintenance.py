"""P1-P3, A14, A15, R1, R3, J6 on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import aggregates as A
from ...operators import maintenance as M
from .base import cte, query, schedule, table
from .episodes import eps

AS_OF = "1998-06-01"
cte("pm", "schedule", """
SELECT *, CAST(next_pm_date - DATE '1998-06-01' AS INTEGER) AS days_remaining,
       CASE WHEN next_pm_date < DATE '1998-06-01' THEN 'overdue' WHEN next_pm_date <= DATE '1998-06-08' THEN 'soon' ELSE 'later' END AS urgency
FROM (SELECT *, CAST(CASE period_unit WHEN 'days' THEN last_pm_date + to_days(period_value) WHEN 'weeks' THEN last_pm_date + to_days(7 * period_value)
             ELSE last_pm_date + to_months(period_value) END AS DATE) AS next_pm_date FROM schedule)""")


@query("p1_next_pm", "pm", "SELECT id, next_pm_date FROM pm")
def p1(spark, sf):
    return schedule(spark, sf).select("id", M.next_pm("last_pm_date", "period_value", "period_unit").alias("next_pm_date"))


def calendar(spark, sf):
    return M.pm_calendar(schedule(spark, sf), AS_OF)


@query("p2_pm_calendar", "pm", "SELECT * FROM pm")
def p2(spark, sf):
    return calendar(spark, sf)


cte("change_log", "", """
SELECT l_orderkey AS pm_id, CAST(l_linenumber AS BIGINT) * 100000 + l_partkey AS version, CASE l_partkey % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'update' ELSE 'schedule' END AS op,
       'U' || CAST(l_suppkey % 14 AS VARCHAR) AS equipment, CAST(l_shipdate AS DATE) AS last_pm_date, CAST(l_linenumber AS INTEGER) AS period_value,
       'weeks' AS period_unit FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, CAST(l_linenumber AS BIGINT) * 100000 + l_partkey ORDER BY l_suppkey, l_shipdate) = 1""")


def change_log(spark, sf):
    from ...operators.cleaning import dedupe_first
    k = F.col("l_partkey") % 5
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("pm_id"), (F.col("l_linenumber").cast("bigint") * 100000 + F.col("l_partkey")).alias("version"),
        F.when(k == 0, "delete").when(k == 1, "update").otherwise("schedule").alias("op"), F.col("l_suppkey"), F.col("l_shipdate"),
        F.col("l_linenumber").alias("period_value"))
    one = dedupe_first(rows, ["pm_id", "version"], ["l_suppkey", "l_shipdate"])
    return one.select("pm_id", "version", "op", F.concat(F.lit("U"), F.col("l_suppkey") % 14).alias("equipment"),
                      F.to_date("l_shipdate").alias("last_pm_date"), "period_value", F.lit("weeks").alias("period_unit"))


# an id lives from a schedule on; a delete ends it until it is scheduled again
@query("p3_current_schedule", "change_log", """
SELECT printf('PM-%04d', pm_id) AS id, equipment, last_pm_date, period_value, period_unit FROM (
  SELECT *, max(CASE WHEN op = 'schedule' THEN version END) OVER w AS made, max(CASE WHEN op = 'delete' THEN version END) OVER w AS gone,
         max(CASE WHEN op <> 'delete' THEN version END) OVER w AS newest FROM change_log WINDOW w AS (PARTITION BY pm_id))
WHERE made IS NOT NULL AND (gone IS NULL OR gone < made) AND version = newest""")
def p3(spark, sf):
    return M.current_schedule(change_log(spark, sf))


@query("a14_maintenance_kpi", "pm", """
SELECT site_id, arg_min(id, (days_remaining, id)) AS next_id, arg_min(equipment, (days_remaining, id)) AS next_equipment,
       min(days_remaining) AS next_days_remaining, count(*) FILTER (WHERE days_remaining BETWEEN 0 AND 7) AS due_this_week
FROM pm GROUP BY site_id""")
def a14(spark, sf):
    return M.maintenance_kpi(calendar(spark, sf), ["site_id"])


cte("site_cards", "", """
SELECT s_suppkey AS site_id, round(abs(s_acctbal) / 100, 1) AS score, s_nationkey AS assets, s_suppkey % 7 AS anomalies, s_suppkey % 40 AS pm_days FROM supplier""")


def site_cards(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("site_id"), F.round(F.abs("s_acctbal") / 100, 1).alias("score"), F.col("s_nationkey").alias("assets"),
        (F.col("s_suppkey") % 7).alias("anomalies"), (F.col("s_suppkey") % 40).alias("pm_days"))


@query("a15_fleet_rollup", "site_cards", """
SELECT CAST(floor(avg(score) + 0.5) AS BIGINT) AS mean_score, CAST(sum(assets) AS BIGINT) AS assets, CAST(sum(anomalies) AS BIGINT) AS anomalies,
       arg_min(site_id, (score, site_id)) AS worst_site, arg_min(site_id, (pm_days, site_id)) AS soonest_pm_site, min(pm_days) AS soonest_pm_days
FROM site_cards""")
def a15(spark, sf):
    return A.fleet_rollup(site_cards(spark, sf))


@query("a15_rank_sites", "site_cards", "SELECT site_id, rank() OVER (ORDER BY score) AS risk_rank FROM site_cards")
def a15_rank(spark, sf):
    return A.rank_sites(site_cards(spark, sf)).select("site_id", "risk_rank")


_REM = """
SELECT 'RM-PM-' || id AS id, 'upcoming_pm' AS kind, equipment, CASE WHEN days_remaining < 0
         THEN printf('Maintenance overdue by %d d for %s', -days_remaining, equipment) ELSE printf('Maintenance due in %d d for %s', days_remaining, equipment) END AS message,
       CAST(next_pm_date AS TIMESTAMP) AS due_at, CASE WHEN days_remaining < 0 THEN 'warning' ELSE 'info' END AS severity FROM pm WHERE days_remaining <= 14
UNION ALL
SELECT 'RM-AN-' || id, 'unacked_anomaly', equipment, 'Unacknowledged ' || severity || ' anomaly on ' || equipment, start,
       CASE WHEN severity = 'critical' THEN 'critical' ELSE 'warning' END FROM eps WHERE status = 'open'"""
cte("reminders", "pm eps", _REM)


@query("r1_reminders", "reminders", "SELECT * FROM reminders")
def r1(spark, sf):
    return M.reminders(calendar(spark, sf), eps(spark, sf))


cte("reminder_log", "", """
SELECT 'RM-AN-' || printf('EV-%05d', event_id - event_id % 3) AS reminder_id, ts AS updated_at, event_type = 'error' AS acknowledged,
       CASE WHEN event_type IN ('view', 'click') THEN value * 10 END AS snooze_hours FROM events""")


def reminder_log(spark, sf):
    t = F.col("event_type")
    return table(spark, sf, "events").select(
        F.concat(F.lit("RM-AN-"), F.format_string("EV-%05d", F.col("event_id") - F.col("event_id") % 3)).alias("reminder_id"),
        F.col("ts").alias("updated_at"), (t == "error").alias("acknowledged"),
        F.when(t.isin("view", "click"), F.col("value") * 10).alias("snooze_hours"))


cte("reminder_state", "reminder_log", """
SELECT reminder_id, bool_or(acknowledged) AS acknowledged, max(updated_at) AS updated_at,
       max_by(updated_at + to_microseconds(CAST(round(snooze_hours * 3600000000.0) AS BIGINT)), updated_at) FILTER (WHERE snooze_hours IS NOT NULL) AS snoozed_until
FROM reminder_log WHERE snooze_hours IS NULL OR (snooze_hours > 0 AND snooze_hours <= 720) GROUP BY reminder_id""")


@query("r3_latest_actions", "reminder_state", "SELECT * FROM reminder_state")
def r3(spark, sf):
    return M.latest_actions(reminder_log(spark, sf))


@query("j6_visible_reminders", "reminders reminder_state", """
SELECT id, kind FROM reminders WHERE id NOT IN (SELECT reminder_id FROM reminder_state
  WHERE acknowledged OR (snoozed_until IS NOT NULL AND snoozed_until > TIMESTAMP '2024-01-20 00:00:00'))""")
def j6(spark, sf):
    rows = M.reminders(calendar(spark, sf), eps(spark, sf))
    return M.visible_reminders(rows, M.latest_actions(reminder_log(spark, sf)), "2024-01-20 00:00:00").select("id", "kind")
