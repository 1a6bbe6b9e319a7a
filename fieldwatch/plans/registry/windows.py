"""W1-W15 on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import constants as K
from ...operators import windows as W
from .base import BLOCK, GAP, KEYS, block, cte, query, readings
from .grid import counts, filled
from .segments import segmented

_NAMES = [f"{c}_{s}_{n}" for c in ("temperature", "humidity") for n in K.ROLLING_WINDOWS for s in ("mean", "std")]


def _roll_sql():
    parts = []
    for c in ("temperature", "humidity"):
        for name, (n, least) in K.ROLLING_WINDOWS.items():
            w = (f"OVER (PARTITION BY site_id, segment_id ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING "
                 "AND CURRENT ROW)")
            for short, fn in (("mean", "avg"), ("std", "stddev_pop")):
                parts.append(f"CASE WHEN count({c}) {w} >= {least} THEN {fn}({c}) {w} END AS {c}_{short}_{name}")
    return ", ".join(parts)


cte("rolled", "seg", f"SELECT *, {_roll_sql()} FROM seg")


@query("w1_rolling_stats", "rolled", f"SELECT event_id, {', '.join(_NAMES)} FROM rolled", " ".join(_NAMES))
def w1(spark, sf):
    out = W.rolling_stats(segmented(spark, sf), KEYS, "ts", ["temperature", "humidity"], max_gap=GAP,
                          block_seconds=BLOCK)
    return out.select("event_id", *_NAMES)


_FRESH = ", ".join(f"least(segment_position / {float(n - 1)}, 1.0)::DOUBLE AS freshness_{k}"
                   for k, (n, _) in K.ROLLING_WINDOWS.items())


@query("w2_freshness", "seg", f"SELECT event_id, {_FRESH} FROM seg",
       "freshness_short freshness_medium freshness_long")
def w2(spark, sf):
    return W.freshness(segmented(spark, sf)).select(
        "event_id", "freshness_short", "freshness_medium", "freshness_long")


_CHANGES = [f"{c}_change_{n}" for c in ("temperature", "humidity") for n in (1, 5)]
_CHANGE_SQL = ", ".join(f"{c} - lag({c}, {n}) OVER (PARTITION BY site_id, segment_id ORDER BY ts) AS {c}_change_{n}"
                        for c in ("temperature", "humidity") for n in (1, 5))


@query("w3_changes", "seg", f"SELECT event_id, {_CHANGE_SQL} FROM seg", " ".join(_CHANGES))
def w3(spark, sf):
    return W.changes(segmented(spark, sf), KEYS, "ts", ["temperature", "humidity"], max_gap=GAP,
                     block_seconds=block(spark, sf, 5 * GAP)).select("event_id", *_CHANGES)


cte("features", "rolled", f"""
SELECT *, {_FRESH}, {_CHANGE_SQL}, temperature_mean_short - temperature_mean_long AS temperature_short_long,
       humidity_mean_short - humidity_mean_long AS humidity_short_long FROM rolled""")


def features(spark, sf):
    return W.state_features(segmented(spark, sf), KEYS, "ts", max_gap=GAP, block_seconds=BLOCK)


@query("w1_w3_state_features", "features", f"SELECT event_id, {', '.join(K.STATE_FEATURES)} FROM features",
       " ".join(K.STATE_FEATURES))
def w13_features(spark, sf):
    return features(spark, sf).select("event_id", *K.STATE_FEATURES)


def _z(c, name):
    w = "OVER (PARTITION BY site_id ORDER BY timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
    return (f"coalesce(CASE WHEN count({c}) {w} >= 6 AND stddev_samp({c}) {w} <> 0 THEN "
            f"({c} - avg({c}) {w}) / stddev_samp({c}) {w} END, 0) AS {name}_zscore")


cte("z0", "filled", f"SELECT *, {_z('temperature', 'temp')}, {_z('humidity', 'humidity')} FROM filled")
cte("z1", "z0", """
SELECT *, CASE WHEN abs(temp_zscore) >= 3 OR abs(humidity_zscore) >= 3 THEN 1 ELSE 0 END AS environmental_anomaly_flag,
       least(greatest((abs(temp_zscore) - 3) / 3, 0), 1) AS temp_anomaly_severity,
       least(greatest((abs(humidity_zscore) - 3) / 3, 0), 1) AS humidity_anomaly_severity FROM z0""")
cte("z2", "z1", """
SELECT *, avg(environmental_anomaly_flag) OVER d AS environmental_anomaly_ratio,
       avg(greatest(temp_anomaly_severity, humidity_anomaly_severity)) OVER d AS environmental_anomaly_severity
FROM z1 WINDOW d AS (PARTITION BY site_id ORDER BY timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
cte("env_burden", "z2", """
SELECT *, least(0.6 * environmental_anomaly_ratio + 0.4 * environmental_anomaly_severity, 1)
          AS environmental_anomaly_burden FROM z2""")
_ZF = ("temp_zscore humidity_zscore temp_anomaly_severity humidity_anomaly_severity environmental_anomaly_ratio "
       "environmental_anomaly_severity environmental_anomaly_burden")


@query("w4_zscore_burden", "env_burden",
       "SELECT site_id, timestamp, environmental_anomaly_flag, " + ", ".join(_ZF.split()) + " FROM env_burden", _ZF)
def w4(spark, sf):
    out = W.zscore_burden(filled(spark, sf), KEYS, "timestamp", {"temperature": "temp", "humidity": "humidity"})
    return out.select("site_id", "timestamp", "environmental_anomaly_flag", *_ZF.split())


def _tv(c):
    o = "OVER (PARTITION BY site_id ORDER BY timestamp"
    day = f"{o} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
    return (f"{c} - lag({c}, 6) {o}) AS {c}_trend_6h, {c} - lag({c}, 24) {o}) AS {c}_trend_24h, "
            f"CASE WHEN count({c}) {day} >= 6 THEN stddev_samp({c}) {day} END AS {c}_volatility_24h")


@query("w5_trend_volatility", "filled", f"""
SELECT site_id, timestamp, {_tv('temperature')},
       avg(temperature) OVER (PARTITION BY site_id ORDER BY timestamp ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)
         AS temperature_smoothed FROM filled""",
       "temperature_trend_6h temperature_trend_24h temperature_volatility_24h temperature_smoothed")
def w5(spark, sf):
    out = W.trend_volatility(filled(spark, sf), KEYS, "timestamp", ["temperature"], smooth=["temperature"])
    return out.select("site_id", "timestamp", "temperature_trend_6h", "temperature_trend_24h",
                      "temperature_volatility_24h", "temperature_smoothed")


def trajectory_sql(c):
    o = "OVER (PARTITION BY site_id ORDER BY timestamp"
    out = {}
    for n in K.TRAJECTORY_LAGS:
        out[f"{c}_lag_{n}h"] = f"lag({c}, {n}) {o})"
    for n in K.TRAJECTORY_CHANGES:
        out[f"{c}_change_{n}h"] = f"{c} - lag({c}, {n}) {o})"
    for n in K.TRAJECTORY_RATES:
        out[f"{c}_rate_{n}h"] = f"({c} - lag({c}, {n}) {o})) / {n}.0"
    for n in K.TRAJECTORY_WINDOWS:
        f = f"{o} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        full = lambda e: f"CASE WHEN count({c}) {f} >= {n} THEN {e} END"  # noqa: E731, B023
        out[f"{c}_rollmean_{n}h"] = full(f"avg({c}) {f}")
        out[f"{c}_rollstd_{n}h"] = full(f"stddev_samp({c}) {f}")
        out[f"{c}_rollmin_{n}h"] = full(f"min({c}) {f}")
        out[f"{c}_rollmax_{n}h"] = full(f"max({c}) {f}")
        out[f"{c}_rollrange_{n}h"] = full(f"max({c}) {f} - min({c}) {f}")
        out[f"{c}_slope_{n}h"] = full(f"regr_slope({c}, i) {f}")
    for n in K.TRAJECTORY_ACCELERATIONS:
        out[f"{c}_accel_{n}h"] = f"({c} - lag({c}, {n}) {o})) - (lag({c}, {n}) {o}) - lag({c}, {2 * n}) {o}))"
    return out


cte("indexed", "filled", """
SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY timestamp) AS DOUBLE) AS i FROM filled""")
_T = trajectory_sql("temperature")


@query("w6_trajectory", "indexed", "SELECT site_id, timestamp, " + ", ".join(
    f"{e} AS {n}" for n, e in _T.items()) + " FROM indexed", " ".join(_T))
def w6(spark, sf):
    return W.trajectory(filled(spark, sf), KEYS, "timestamp", ["temperature"]).select(
        "site_id", "timestamp", *_T)


@query("w7_rolling_slope", "indexed", f"""
SELECT site_id, timestamp, {_T['temperature_slope_12h']} AS temperature_slope_12h FROM indexed""", "temperature_slope_12h")
def w7(spark, sf):
    return W.rolling_slope(filled(spark, sf), KEYS, "timestamp", "temperature", 12).select(
        "site_id", "timestamp", "temperature_slope_12h")


@query("w8_acceleration", "indexed", f"""
SELECT site_id, timestamp, {_T['temperature_accel_3h']} AS temperature_accel_3h FROM indexed""", "temperature_accel_3h")
def w8(spark, sf):
    return W.acceleration(filled(spark, sf), KEYS, "timestamp", "temperature", 3).select(
        "site_id", "timestamp", "temperature_accel_3h")


# the hourly readings stand in for the four health series
cte("health_like", "filled", """
SELECT site_id, timestamp, temperature AS overall_site_health, temperature AS environmental_health_score,
       humidity AS energy_health_score, temp_std_1h AS battery_health_score,
       100 - temperature AS environmental_risk_score, 100 - humidity AS energy_risk_score,
       100 - temp_std_1h AS battery_risk_score, humidity_std_1h AS energy_anomaly_burden,
       temp_std_1h AS battery_anomaly_burden FROM filled""")


def health_like(spark, sf):
    t, h, s = F.col("temperature"), F.col("humidity"), F.col("temp_std_1h")
    return filled(spark, sf).select(
        "site_id", "timestamp", t.alias("overall_site_health"), t.alias("environmental_health_score"),
        h.alias("energy_health_score"), s.alias("battery_health_score"),
        (100 - t).alias("environmental_risk_score"), (100 - h).alias("energy_risk_score"),
        (100 - s).alias("battery_risk_score"), F.col("humidity_std_1h").alias("energy_anomaly_burden"),
        s.alias("battery_anomaly_burden"))


def _base_sql():
    o = "OVER (PARTITION BY site_id ORDER BY timestamp"
    x, out = "overall_site_health", {}
    for n in K.HEALTH_LAGS:
        out[f"overall_health_lag_{n}h"] = f"lag({x}, {n}) {o})"
    for n in K.HEALTH_WINDOWS:
        f = f"{o} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for short, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min")):
            out[f"health_{short}_{n}h"] = f"CASE WHEN count({x}) {f} >= {n} THEN {fn}({x}) {f} END"
    for c in K.SUBSYSTEM_HEALTH:
        for n in K.SUBSYSTEM_LAGS:
            out[f"{c}_lag_{n}h"] = f"lag({c}, {n}) {o})"
    for n in K.HEALTH_CHANGES:
        out[f"overall_health_change_{n}h"] = f"{x} - lag({x}, {n}) {o})"
    return out


_B = _base_sql()


@query("w9_base_features", "health_like", "SELECT site_id, timestamp, " + ", ".join(
    f"{e} AS {n}" for n, e in _B.items()) + " FROM health_like", " ".join(_B))
def w9(spark, sf):
    return W.base_features(health_like(spark, sf), KEYS, "timestamp").select("site_id", "timestamp", *_B)


@query("w10_targets", "health_like", """
SELECT site_id, timestamp, ahead AS target_health_6h, ahead - x AS target_health_change_6h,
       CASE WHEN ahead - x IS NULL THEN NULL WHEN ahead - x <= -10 THEN 1 ELSE 0 END AS major_drop_6h,
       CASE WHEN ahead - x IS NULL THEN NULL WHEN ahead - x <= -20 THEN 1 ELSE 0 END AS severe_drop_6h
FROM (SELECT *, overall_site_health AS x, lead(overall_site_health, 6) OVER (PARTITION BY site_id ORDER BY timestamp)
      AS ahead FROM health_like)""", "target_health_6h target_health_change_6h")
def w10(spark, sf):
    return W.targets(health_like(spark, sf), KEYS, "timestamp").select(
        "site_id", "timestamp", "target_health_6h", "target_health_change_6h", "major_drop_6h", "severe_drop_6h")


cte("decay_in", "counts", """
SELECT site_id, timestamp, date_diff('hour', TIMESTAMP '1970-01-01', timestamp) AS t, outage_count AS x,
       CASE WHEN check_battery_count + discharge_count + low_battery_count + chatter_count > 0 THEN 1 ELSE 0 END AS y
FROM counts""")


@query("w11_decayed_sum", "decay_in", """
SELECT a.site_id, a.timestamp, sum(b.x * power(0.5, (a.t - b.t) / 8.0)) AS outage_load,
       sum(b.y * power(0.5, (a.t - b.t) / 8.0)) AS recurrence_load
FROM decay_in a JOIN decay_in b ON a.site_id = b.site_id AND b.t <= a.t GROUP BY ALL""", "outage_load recurrence_load")
def w11(spark, sf):
    c = counts(spark, sf)
    active = sum((F.col(f"{n}_count") for n in K.BATTERY_FLAGS.values()), F.lit(0)) > 0
    loads = W.decayed_sums(c.withColumn("active", active.cast("int")), KEYS, "timestamp",
                           {"outage_load": "outage_count", "recurrence_load": "active"}, K.HALF_LIFE_HOURS)
    return loads.select("site_id", "timestamp", "outage_load", "recurrence_load")


@query("w12_chrono_split_rows", "filled", """
SELECT site_id, timestamp, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.85::DOUBLE) THEN 'validation'
       ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY timestamp) AS k, count(*) OVER (PARTITION BY site_id) AS n
      FROM filled)""")
def w12(spark, sf):
    return W.chrono_split(filled(spark, sf), KEYS, "timestamp").select("site_id", "timestamp", "split")


@query("w12_chrono_split_days", "readings", """
SELECT event_id, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END AS split
FROM readings JOIN (SELECT site_id, d, row_number() OVER (PARTITION BY site_id ORDER BY d) AS k,
                           count(*) OVER (PARTITION BY site_id) AS n
                    FROM (SELECT DISTINCT site_id, CAST(ts AS DATE) AS d FROM readings)) x
  ON x.site_id = readings.site_id AND x.d = CAST(ts AS DATE)""")
def w12_days(spark, sf):
    return W.chrono_split(readings(spark, sf), KEYS, "ts", by="day").select("event_id", "split")


_CROSS = ("interaction_energy_battery_risk interaction_environmental_energy_risk interaction_environmental_battery_risk "
          "interaction_energy_battery_anomaly_burden max_subsystem_risk min_subsystem_health subsystem_health_spread")


@query("w14_cross_features", "health_like", """
SELECT site_id, timestamp, r2 * r3 AS interaction_energy_battery_risk, r1 * r2 AS interaction_environmental_energy_risk,
       r1 * r3 AS interaction_environmental_battery_risk, b2 * b3 AS interaction_energy_battery_anomaly_burden,
       greatest(r1, r2, r3) AS max_subsystem_risk, least(h1, h2, h3) AS min_subsystem_health,
       greatest(h1, h2, h3) - least(h1, h2, h3) AS subsystem_health_spread,
       CAST(coalesce(h1 < 80, false) AS INTEGER) + CAST(coalesce(h2 < 80, false) AS INTEGER)
         + CAST(coalesce(h3 < 80, false) AS INTEGER) AS subsystems_below_80,
       CAST(coalesce(h1 < 60, false) AS INTEGER) + CAST(coalesce(h2 < 60, false) AS INTEGER)
         + CAST(coalesce(h3 < 60, false) AS INTEGER) AS subsystems_below_60
FROM (SELECT *, environmental_health_score AS h1, energy_health_score AS h2, battery_health_score AS h3,
      environmental_risk_score AS r1, energy_risk_score AS r2, battery_risk_score AS r3,
      energy_anomaly_burden AS b2, battery_anomaly_burden AS b3 FROM health_like)""", _CROSS)
def w14(spark, sf):
    return W.cross_features(health_like(spark, sf)).select(
        "site_id", "timestamp", *_CROSS.split(), "subsystems_below_80", "subsystems_below_60")


@query("w15_calendar", "readings", """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
       CAST(month(ts) AS INTEGER) AS month, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
       sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
       sin(2 * pi() * (isodow(ts) - 1) / 7) AS day_of_week_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS day_of_week_cos
FROM readings""", "hour_sin hour_cos day_of_week_sin day_of_week_cos")
def w15(spark, sf):
    return W.calendar_features(readings(spark, sf).select("event_id", "ts"), "ts").drop("ts")
