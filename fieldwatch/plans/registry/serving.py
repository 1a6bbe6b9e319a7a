"""Q1-Q10, T5, J8, R2 and forecast points on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import forecasting as FC
from ...operators import hourgrid as H
from ...operators import maintenance as M
from ...sources import layers
from .. import serving as Q
from .alarms_scoring import gold_hourly
from .base import KEYS, cte, query, readings, schedule, table
from .episodes import _window, _hist, _STATS, actions, eps, units
from .maintenance import AS_OF, calendar, reminder_log

SIGMA = 10.0
_SCORES = {"global": "overall_site_health", **Q.DOMAINS}
cte("day_before", "scored", """
SELECT * FROM (SELECT *, max(timestamp) OVER (PARTITION BY site_id) AS latest FROM scored) WHERE timestamp <= latest - INTERVAL 24 HOUR
QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY timestamp DESC) = 1""")
cte("overview", "last_hour day_before", " UNION ALL ".join(
    f"SELECT l.site_id, l.timestamp AS updated_at, 0.0::DOUBLE AS shift_days, '{d}' AS domain, round_even(l.{c} * 10, 0) / 10 AS score, "
    f"round_even(p.{c} * 10, 0) / 10 AS previous_score FROM last_hour l JOIN day_before p ON p.site_id = l.site_id" for d, c in _SCORES.items()))


@query("q1_overview", "overview", """
SELECT *, CASE WHEN score >= 90 THEN 'healthy' WHEN score >= 60 THEN 'watch' ELSE 'critical' END AS status FROM overview""",
       "score previous_score shift_days")
def q1(spark, sf):
    return Q.overview(gold_hourly(spark, sf), layers.gold_meta(readings(spark, sf), KEYS), KEYS)


@query("q2_history", "scored", """
SELECT site_id, day, round_even(a * 10, 0) / 10 AS global_score, round_even(b * 10, 0) / 10 AS environment, round_even(c * 10, 0) / 10 AS energy,
       round_even(d * 10, 0) / 10 AS battery
FROM (SELECT site_id, date_trunc('day', timestamp)::TIMESTAMP AS day, avg(overall_site_health) AS a, avg(environmental_health_score) AS b,
             avg(energy_health_score) AS c, avg(battery_health_score) AS d FROM scored GROUP BY ALL)
WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY day DESC) <= 7""", "global_score environment energy battery")
def q2(spark, sf):
    return Q.history(gold_hourly(spark, sf), KEYS, "7d")


# --- forecast points of the persistence baseline -----------------------------------------
def _points(name, hours, step, count):
    return f"""
SELECT site_id, '{name}' AS horizon, last - to_hours({step} * behind) AS timestamp, avg(x) AS value, avg(x) AS lower, avg(x) AS upper, false AS is_forecast
FROM (SELECT site_id, overall_site_health AS x, last, CAST(floor(date_diff('hour', timestamp, last) / {step}.0) AS BIGINT) AS behind FROM dated)
WHERE behind < {count} GROUP BY site_id, last, behind
UNION ALL
SELECT site_id, '{name}', last + to_hours(k * {step}), x, avg(lo), avg(hi), true FROM (
  SELECT site_id, last, x, k, {_band('greatest(0, x - 10 * sqrt({j}))')} AS lo, {_band('least(100, x + 10 * sqrt({j}))')} AS hi
  FROM anchors CROSS JOIN (SELECT unnest(generate_series(1, {hours // step})) AS k)
       CROSS JOIN (SELECT unnest(generate_series(0, {max(step // 6, 1) - 1})) AS e)
  WHERE {step} >= 6 AND k * {step} + e * 6 <= {hours}) GROUP BY ALL
UNION ALL
SELECT site_id, '{name}', last + to_hours(k), x, lo0 + (lo1 - lo0) * (k % 6) / 6.0, hi0 + (hi1 - hi0) * (k % 6) / 6.0, true
FROM (SELECT site_id, last, x, k, CASE WHEN k < 6 THEN x ELSE greatest(0, x - 10 * sqrt(k // 6)) END AS lo0, greatest(0, x - 10 * sqrt(k // 6 + 1)) AS lo1,
             CASE WHEN k < 6 THEN x ELSE least(100, x + 10 * sqrt(k // 6)) END AS hi0, least(100, x + 10 * sqrt(k // 6 + 1)) AS hi1
      FROM anchors CROSS JOIN (SELECT unnest(generate_series(1, {hours})) AS k) WHERE {step} = 1)"""


def _band(expr):
    return expr.format(j="(k * STEP // 6 + e)")


def _all_points():
    from ...constants import HORIZONS
    return " UNION ALL ".join(_points(n, *c).replace("STEP", str(c[1])) for n, c in HORIZONS.items())


cte("dated", "scored", "SELECT *, max(timestamp) OVER (PARTITION BY site_id) AS last FROM scored")
cte("anchors", "dated", "SELECT site_id, last, overall_site_health AS x FROM dated WHERE timestamp = last")
cte("points", "dated anchors", f"""
SELECT site_id, horizon, timestamp, round_even(value * 100, 0) / 100 AS value, round_even(lower * 100, 0) / 100 AS lower,
       round_even(upper * 100, 0) / 100 AS upper, is_forecast FROM ({_all_points()})""")


def points(spark, sf, hourly=None):
    hourly = hourly if hourly is not None else gold_hourly(spark, sf)
    slim = hourly.select("site_id", "timestamp", "overall_site_health")
    return FC.forecast_points(slim, FC.persistence_trajectory(slim, KEYS, 720, SIGMA), KEYS)


@query("m16_forecast_points", "points", "SELECT * FROM points", "value lower upper")
def m16(spark, sf):
    return points(spark, sf)


@query("t5_first_crossing", "points", """
SELECT site_id, horizon, min(timestamp) AS timestamp, 60.0::DOUBLE AS threshold FROM points WHERE is_forecast AND lower < 60 GROUP BY ALL""", "threshold")
def t5(spark, sf):
    return Q.first_crossing(points(spark, sf), ["site_id", "horizon"], 60)


def _cross(t, s):
    return f"""
SELECT p.site_id, p.horizon, min(p.timestamp) AS timestamp, {t}.0::DOUBLE AS threshold, '{s}' AS severity FROM low_points p JOIN point_anchor a
  ON a.site_id = p.site_id AND a.horizon = p.horizon WHERE is_forecast AND lower < {t} AND a.v >= {t} GROUP BY p.site_id, p.horizon"""


# thresholds apply to health around 90; the stand-in sites sit lower, so points are lifted
cte("low_points", "points", """
SELECT * REPLACE (least(value + 45, 100) AS value, least(lower + 45, 100) AS lower, least(upper + 45, 100) AS upper) FROM points""")
cte("point_anchor", "low_points", "SELECT site_id, horizon, arg_max(value, timestamp) AS v FROM low_points WHERE NOT is_forecast GROUP BY ALL")
cte("crossings", "low_points point_anchor", _cross(90, "watch") + " UNION ALL " + _cross(60, "critical"))


def lifted(spark, sf, hourly=None):
    return points(spark, sf, hourly).withColumns({c: F.least(F.col(c) + 45, F.lit(100.0)) for c in ("value", "lower", "upper")})


@query("q3_forecast_crossings", "crossings", "SELECT * FROM crossings", "threshold")
def q3(spark, sf):
    return Q.crossings(lifted(spark, sf), ["site_id", "horizon"])


@query("q3_forecast_horizon", "points", "SELECT * FROM points WHERE horizon = '7d'", "value lower upper")
def q3_horizon(spark, sf):
    return Q.forecast(points(spark, sf), "7d")


cte("faults", "last_hour crossings", " UNION ALL ".join(f"""
SELECT l.site_id, '{d}' AS domain, round_even(l.{c} * 10, 0) / 10 AS score, CASE WHEN main_risk_driver = '{n}' THEN x.timestamp END AS predicted_at,
       CASE WHEN main_risk_driver = '{n}' AND x.timestamp IS NOT NULL THEN CASE WHEN x.severity = 'critical' THEN 'critical' ELSE 'alert' END END AS severity
FROM last_hour l LEFT JOIN (SELECT * FROM crossings WHERE horizon = '7d' QUALIFY row_number() OVER (PARTITION BY site_id
   ORDER BY timestamp, CASE severity WHEN 'watch' THEN 0 ELSE 1 END) = 1) x ON x.site_id = l.site_id"""
    for n, d, c in (("Environmental", "environment", "environmental_health_score"), ("Energy", "energy", "energy_health_score"),
                    ("Battery", "battery", "battery_health_score"))))


def faults(spark, sf):
    hourly = gold_hourly(spark, sf)
    return Q.predicted_faults(hourly, Q.forecast(lifted(spark, sf, hourly), "7d"), KEYS)


@query("q4_j8_predicted_faults", "faults", "SELECT * FROM faults", "score")
def q4(spark, sf):
    return faults(spark, sf)


@query("a16_next_fault", "faults", """
SELECT site_id, domain, predicted_at, severity FROM faults WHERE predicted_at IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY predicted_at, domain) = 1""")
def a16_fault(spark, sf):
    return Q.next_fault(faults(spark, sf), KEYS)


@query("q5_subscore_forecast", "points scored last_hour", " UNION ALL ".join(f"""
SELECT p.site_id, p.timestamp, '{d}' AS domain, round_even(s.{c} * 10, 0) / 10 AS value, round_even(s.{c} * 10, 0) / 10 AS lower,
       round_even(s.{c} * 10, 0) / 10 AS upper, false AS is_forecast FROM points p JOIN scored s ON s.site_id = p.site_id AND s.timestamp = p.timestamp
WHERE NOT is_forecast AND horizon = '7d' AND s.{c} IS NOT NULL
UNION ALL SELECT p.site_id, p.timestamp, '{d}', round_even(l.{c} * 10, 0) / 10, round_even(greatest(0, l.{c} - (value - lower)) * 10, 0) / 10,
       round_even(least(100, l.{c} + (upper - value)) * 10, 0) / 10, true FROM points p JOIN last_hour l ON l.site_id = p.site_id
WHERE p.is_forecast AND horizon = '7d'""" for d, c in Q.DOMAINS.items()), "value lower upper")
def q5(spark, sf):
    hourly = gold_hourly(spark, sf)
    return Q.subscore_forecast(hourly, Q.forecast(points(spark, sf, hourly), "7d"), KEYS)


@query("r2_threshold_reminders", "low_points bounds", """
SELECT site_id, 'RM-TH-' || CAST(site_id AS VARCHAR) AS id, 'threshold_approach' AS kind, 'site' AS equipment,
       'Forecast falls below 90 within 24 h' AS message, min(timestamp) AS due_at, 'warning' AS severity
FROM low_points JOIN bounds USING (site_id) WHERE is_forecast AND horizon = '24h' AND lower < 90 AND timestamp <= last_ts + INTERVAL 24 HOUR GROUP BY site_id""")
def r2(spark, sf):
    ref = H.observation_bounds(readings(spark, sf), KEYS, "ts")
    return M.threshold_reminders(Q.forecast(lifted(spark, sf), "24h"), KEYS, 90.0, ref)


@query("q6_list_episodes", "eps actions", """
SELECT e.id, equipment, coalesce(a.status, e.status) AS status FROM eps e LEFT JOIN actions a ON a.id = e.id
WHERE severity = 'critical' AND start >= TIMESTAMP '2024-01-10'""")
def q6(spark, sf):
    out = Q.list_episodes(eps(spark, sf), actions(spark, sf), severity="critical", start="2024-01-10 00:00:00")
    return out.select("id", "equipment", "status")


cte("eps_over", "eps actions", "SELECT e.* REPLACE (coalesce(a.status, e.status) AS status) FROM eps e LEFT JOIN actions a ON a.id = e.id")


@query("q7_stats", "eps_over bounds", _STATS.format(src="eps_over"), "anomaly_rate_pct mtba_hours")
def q7(spark, sf):
    span = H.observation_bounds(readings(spark, sf), KEYS, "ts").select("site_id", "span_days")
    rows = Q.list_episodes(eps(spark, sf), actions(spark, sf)).join(span, KEYS)
    return Q.stats(rows, F.col("span_days"), ["site_id", "span_days"]).drop("span_days")


@query("q7_histogram", "eps", _hist("week"))
def q7_hist(spark, sf):
    return Q.histogram(eps(spark, sf), "week", KEYS)


@query("q7_window_kpis", "eps units bounds", _window(168), "rate_pct")
def q7_window(spark, sf):
    return Q.window_kpis(eps(spark, sf), "7d", H.observation_bounds(readings(spark, sf), KEYS, "ts"), units(spark, sf), KEYS)


cte("requests", "", """
SELECT printf('EV-%05d', user_id * 20) AS id, CASE event_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'acknowledged' WHEN 2 THEN 'resolved' ELSE 'bogus' END AS status,
       ts AS updated_at FROM events""")


@query("q8_set_status", "eps requests", """
SELECT e.id, e.start, r.status FROM eps e JOIN (SELECT * FROM requests WHERE status <> 'bogus'
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1) r ON r.id = e.id""")
def q8(spark, sf):
    n = F.col("event_id") % 4
    wanted = F.when(n == 0, "open").when(n == 1, "acknowledged").when(n == 2, "resolved").otherwise("bogus")
    requests = table(spark, sf, "events").select(F.format_string("EV-%05d", F.col("user_id") * 20).alias("id"),
                                                 wanted.alias("status"), F.col("ts").alias("updated_at"))
    return Q.set_status(requests, eps(spark, sf)).select("id", "start", "status")


@query("q9_active_reminders", "reminders reminder_state", """
SELECT id, kind, equipment, due_at, severity FROM reminders WHERE id NOT IN (SELECT reminder_id FROM reminder_state
  WHERE acknowledged OR (snoozed_until IS NOT NULL AND snoozed_until > TIMESTAMP '2024-01-25 00:00:00'))""")
def q9(spark, sf):
    return Q.active_reminders(calendar(spark, sf), eps(spark, sf), reminder_log(spark, sf), "2024-01-25 00:00:00").drop("message")


@query("q9_reminder_count", "reminders", "SELECT kind, count(*) AS n FROM reminders GROUP BY kind")
def q9_count(spark, sf):
    return Q.reminder_count(M.reminders(calendar(spark, sf), eps(spark, sf)), ["kind"])


@query("q10_equipment", "schedule", "SELECT DISTINCT equipment FROM schedule")
def q10(spark, sf):
    return Q.equipment(schedule(spark, sf))


@query("q10_calendar", "pm", "SELECT * FROM pm")
def q10_calendar(spark, sf):
    return Q.calendar(schedule(spark, sf), AS_OF)


@query("s13_latest_hour", "last_hour", "SELECT site_id, timestamp, overall_site_health FROM last_hour", "overall_site_health")
def s13(spark, sf):
    from ...operators.scoring import latest_row
    return latest_row(gold_hourly(spark, sf).select("site_id", "timestamp", "overall_site_health"), KEYS)
