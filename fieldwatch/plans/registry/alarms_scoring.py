"""A3, A4, A18, H1-H18 on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import constants as K
from ...operators import aggregates as A
from ...operators import scoring as S
from ...operators.cleaning import categorise, keyword_flags
from ...session import durable_checkpoint
from .base import KEYS, alarms, cte, query, readings, table
from .grid import counts, filled
from .segments import alarm_events

EVENT_KEYS = ["site_id", "alarm_event"]


def _count(words):
    return "CAST(count(*) FILTER (WHERE " + " OR ".join(
        f"contains(upper(message), '{w}')" for w in words) + ") AS BIGINT)"


cte("ev0", "alarm_events", f"""
SELECT site_id, alarm_event, min(log_time) AS start_time, max(log_time) AS end_time,
       (epoch_us(max(log_time)) - epoch_us(min(log_time))) / 1000000.0 AS duration_sec,
       count(message) AS total_alarms, count(DISTINCT message) AS unique_alarm_types,
       count(*) FILTER (WHERE state = 'A') AS active_alarms, count(*) FILTER (WHERE state = 'D') AS cleared_alarms,
       {', '.join(f'{_count(w)} AS {n}_alarm_count' for n, w in K.EVENT_KEYWORDS.items())}
FROM alarm_events GROUP BY site_id, alarm_event""")
cte("event_features", "ev0", """
SELECT *, CAST(hour(start_time) AS INTEGER) AS hour, CAST(isodow(start_time) - 1 AS INTEGER) AS weekday,
       CAST(month(start_time) AS INTEGER) AS month, unique_alarm_types / total_alarms AS alarm_diversity,
       active_alarms / (active_alarms + cleared_alarms + 1e-6) AS active_ratio,
       total_alarms / (duration_sec + 1) AS alarm_rate, unique_alarm_types * duration_sec AS complexity,
       ups_alarm_count / total_alarms AS ups_ratio, CASE WHEN generator_alarm_count > 0 THEN 1 ELSE 0 END AS generator_present,
       total_alarms / unique_alarm_types AS repetition_factor,
       total_alarms / (duration_sec + 1) * unique_alarm_types AS event_intensity FROM ev0""")
_EF = ("duration_sec alarm_diversity active_ratio alarm_rate complexity ups_ratio repetition_factor event_intensity")


def events(spark, sf):
    return A.event_features(alarm_events(spark, sf), EVENT_KEYS, "log_time", "message", "state")


@query("a3_event_features", "event_features", "SELECT * FROM event_features", _EF)
def a3(spark, sf):
    return events(spark, sf)


@query("a4_dominant_category", "alarm_events", """
SELECT site_id, alarm_event, category AS dominant_category FROM (
  SELECT site_id, alarm_event, CASE WHEN regexp_matches(upper(message), 'UPS|SOCOMEC|BATTERY') THEN 'UPS'
         WHEN regexp_matches(upper(message), 'CLIM|STULZ|LIEBERT|TEMPERATURE') THEN 'CLIM'
         WHEN regexp_matches(upper(message), 'TENSION|ELECTROGENE') THEN 'ENERGY' ELSE 'OTHER' END AS category, count(*) AS n
  FROM alarm_events GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY site_id, alarm_event ORDER BY n DESC, category) = 1""")
def a4(spark, sf):
    return A.dominant(categorise(alarm_events(spark, sf), "message"), EVENT_KEYS, "category")


@query("h1_p95_norm", "filled", """
SELECT site_id, timestamp, CASE WHEN p > 0 THEN least(x / p, 1) ELSE 0 END AS scaled
FROM (SELECT site_id, timestamp, greatest(coalesce(temp_std_1h, 0), 0) AS x FROM filled)
JOIN (SELECT site_id, quantile_cont(greatest(coalesce(temp_std_1h, 0), 0), 0.95) AS p FROM filled GROUP BY site_id)
  USING (site_id)""", "scaled")
def h1(spark, sf):
    return S.p95_norm(filled(spark, sf), KEYS, {"scaled": "temp_std_1h"}).select("site_id", "timestamp", "scaled")


@query("h2_saturate", "filled", """
SELECT site_id, timestamp, CASE WHEN p > 0 THEN 1 - exp(-x / p) ELSE 0 END AS auto, 1 - exp(-x / 6) AS fixed
FROM (SELECT site_id, timestamp, greatest(coalesce(temp_std_1h, 0), 0) AS x FROM filled)
JOIN (SELECT site_id, quantile_cont(greatest(coalesce(temp_std_1h, 0), 0), 0.95) AS p FROM filled GROUP BY site_id)
  USING (site_id)""", "auto fixed")
def h2(spark, sf):
    out = S.saturate(filled(spark, sf), KEYS, {"auto": "temp_std_1h"})
    return S.saturate(out, KEYS, {"fixed": "temp_std_1h"}, 6).select("site_id", "timestamp", "auto", "fixed")


@query("h3_pm_risk", None, """
SELECT o_orderkey, least(greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01'), 0) / 90.0, 1)::DOUBLE AS pm_risk
FROM orders""", "pm_risk")
def h3(spark, sf):
    now = F.lit("1998-01-01").cast("timestamp_ntz")
    return table(spark, sf, "orders").select("o_orderkey", S.pm_risk(now, F.col("o_orderdate"), 90).alias("pm_risk"))


cte("env_terms", "env_burden", """
SELECT b.*, least(greatest((temperature - 26) / 10, 0), 1) * CASE WHEN temperature IS NULL THEN NULL ELSE 1 END AS temp_term,
       least(greatest((abs(humidity - 46) - 4) / 15, 0), 1) * CASE WHEN humidity IS NULL THEN NULL ELSE 1 END AS humidity_term,
       CASE WHEN p1 > 0 THEN least(temp_std_1h / p1, 1) ELSE 0 END AS temp_change_term,
       CASE WHEN p2 > 0 THEN least(humidity_std_1h / p2, 1) ELSE 0 END AS humidity_change_term
FROM env_burden b JOIN (SELECT site_id, quantile_cont(temp_std_1h, 0.95) AS p1, quantile_cont(humidity_std_1h, 0.95) AS p2
                        FROM filled GROUP BY site_id) USING (site_id)""")
_ENV = "temp_term humidity_term temp_change_term humidity_change_term"


@query("h4_env_terms", "env_terms", "SELECT site_id, timestamp, " + ", ".join(_ENV.split()) + " FROM env_terms", _ENV)
def h4(spark, sf):
    return S.env_terms(filled(spark, sf), KEYS).select("site_id", "timestamp", *_ENV.split())


# --- energy and battery: loads by direct summation, durations by islands ----------------
_LOADS = [*K.ENERGY_FLAGS.values(), *K.BATTERY_FLAGS.values()]
cte("loads_in", "counts", """
SELECT *, date_diff('hour', TIMESTAMP '1970-01-01', timestamp) AS t,
       CASE WHEN check_battery_count + discharge_count + low_battery_count + chatter_count > 0 THEN 1 ELSE 0 END
         AS battery_alarm_active,
       CASE WHEN outage_count > 0 THEN 1 ELSE 0 END AS outage_active_hour FROM counts""")
cte("loads", "loads_in", "SELECT a.site_id, a.timestamp, " + ", ".join(
    f"sum(b.{n}_count * power(0.5, (a.t - b.t) / 8.0)) AS {n}_load" for n in _LOADS) + """,
       sum(b.battery_alarm_active * power(0.5, (a.t - b.t) / 8.0)) AS recurrence_load
FROM loads_in a JOIN loads_in b ON a.site_id = b.site_id AND b.t <= a.t GROUP BY ALL""")


def _duration(flag, out):
    return f"""(SELECT site_id, timestamp, row_number() OVER (PARTITION BY site_id, island ORDER BY timestamp)
       - CASE WHEN island > 0 THEN 1 ELSE 0 END AS {out}
  FROM (SELECT *, sum(1 - {flag}) OVER (PARTITION BY site_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS island
        FROM loads_in))"""


cte("log_hours", "loads loads_in", f"""
SELECT * EXCLUDE (t), outage_load + supply_load + generator_load + transfer_load AS total_energy_load
FROM loads_in JOIN loads USING (site_id, timestamp)
JOIN {_duration('outage_active_hour', 'outage_duration_hours')} USING (site_id, timestamp)
JOIN {_duration('battery_alarm_active', 'battery_alarm_duration_hours')} USING (site_id, timestamp)""")
_SCALED = {**{f"{n}_term": f"{n}_load" for n in K.ENERGY_FLAGS.values()},
           "energy_frequency_anomaly": "total_energy_load",
           **{f"{n}_component": f"{n}_load" for n in [*K.BATTERY_FLAGS.values(), "recurrence"]}}
cte("log_terms", "log_hours", "SELECT l.*, " + ", ".join(
    f"CASE WHEN p_{c} > 0 THEN 1 - exp(-{c} / p_{c}) ELSE 0 END AS {o}" for o, c in _SCALED.items()) + """,
       1 - exp(-outage_duration_hours / 6.0) AS persistence_term, 1 - exp(-outage_duration_hours / 6.0) AS energy_duration_anomaly,
       1 - exp(-battery_alarm_duration_hours / 6.0) AS persistence_component
FROM log_hours l JOIN (SELECT site_id, """ + ", ".join(
    f"quantile_cont({c}, 0.95) AS p_{c}" for c in _SCALED.values()) + " FROM log_hours GROUP BY site_id) USING (site_id)")
cte("battery_hours", "log_terms", """
SELECT *, 0.5 * persistence_component + 0.5 * recurrence_component AS battery_anomaly_burden FROM log_terms""")

_EN = [*[f"{n}_load" for n in K.ENERGY_FLAGS.values()], *K.WEIGHTS["energy"], "total_energy_load",
       "energy_frequency_anomaly", "energy_duration_anomaly"]
_BA = [*[f"{n}_load" for n in K.BATTERY_FLAGS.values()], "recurrence_load", *K.WEIGHTS["battery"], "battery_anomaly_burden"]


def flagged(spark, sf):
    return keyword_flags(alarms(spark, sf), "message")


@query("h5_energy_hourly", "battery_hours",
       f"SELECT site_id, timestamp, outage_duration_hours, {', '.join(_EN)} FROM battery_hours", " ".join(_EN))
def h5(spark, sf):
    return S.energy_hourly(flagged(spark, sf), KEYS).select("site_id", "timestamp", "outage_duration_hours", *_EN)


@query("h6_battery_hourly", "battery_hours",
       f"SELECT site_id, timestamp, battery_alarm_duration_hours, {', '.join(_BA)} FROM battery_hours", " ".join(_BA))
def h6(spark, sf):
    return S.battery_hourly(flagged(spark, sf), KEYS).select(
        "site_id", "timestamp", "battery_alarm_duration_hours", *_BA)


_ACT = list(K.WEIGHTS["energy"])


@query("a18_active_terms", "battery_hours", "SELECT site_id, " + ", ".join(
    f"coalesce(max({t}) > 0, false) AS {t}_active" for t in _ACT) + " FROM battery_hours GROUP BY site_id")
def a18(spark, sf):
    return S.active_terms(S.energy_hourly(flagged(spark, sf), KEYS), KEYS, _ACT)


def _base(domain, source):
    w = K.WEIGHTS[domain]
    on = ", ".join(f"CASE WHEN max({t}) OVER (PARTITION BY site_id) > 0 THEN {x} ELSE 0 END AS w_{t}" for t, x in w.items())
    risk = " + ".join(f"CASE WHEN w_{t} > 0 THEN w_{t} * {t} ELSE 0 END" for t in w)
    total = " + ".join(f"w_{t}" for t in w)
    return (f"SELECT *, least(greatest(100 * ({risk}) / ({total}), 0), 100) * CASE WHEN ({risk}) IS NULL THEN NULL ELSE 1 END "
            f"AS {domain}_base_risk FROM (SELECT *, {on} FROM {source})")


def _pm(at, first, days):
    return f"least(greatest((epoch_us({at}) - epoch_us({first})) / 86400000000.0, 0) / {days}.0, 1)"


def _final(domain):
    wa, wm = K.MULTIPLIERS[domain]
    return (f"least({domain}_base_risk * (1 + {wa} * {domain}_anomaly_burden) * (1 + {wm} * {domain}_pm_risk), 100) "
            f"* CASE WHEN {domain}_base_risk IS NULL THEN NULL ELSE 1 END")


cte("env_base", "env_terms", _base("environmental", "env_terms"))
cte("env_scores", "env_base", f"""
SELECT *, 100 - environmental_risk_score AS environmental_health_score FROM (SELECT *, {_final('environmental')}
  AS environmental_risk_score FROM (SELECT *, {_pm('timestamp', "TIMESTAMP '2026-03-01'", 90)} AS environmental_pm_risk FROM env_base))""")
cte("energy_base", "battery_hours", _base("energy", "battery_hours"))
_n = " + ".join(f"CASE WHEN w_{t} > 0 THEN 1 ELSE 0 END" for t in K.WEIGHTS["energy"])
_s = " + ".join(f"CASE WHEN w_{t} > 0 THEN {t} ELSE 0 END" for t in K.WEIGHTS["energy"])
cte("energy_scores", "energy_base", f"""
SELECT *, 100 - energy_risk_score AS energy_health_score FROM (SELECT *, {_final('energy')} AS energy_risk_score
  FROM (SELECT *, 0.40 * energy_frequency_anomaly + 0.35 * energy_duration_anomaly + 0.25 * energy_sequence_anomaly
          AS energy_anomaly_burden, {_pm('timestamp', "TIMESTAMP '2022-12-13'", 180)} AS energy_pm_risk
        FROM (SELECT *, ({_s}) / ({_n}) AS energy_sequence_anomaly FROM energy_base)))""")
cte("battery_base", "battery_hours", _base("battery", "battery_hours"))
cte("battery_scores", "battery_base", f"""
SELECT *, 100 - battery_risk_score AS battery_health_score FROM (SELECT *, {_final('battery')} AS battery_risk_score
  FROM (SELECT *, {_pm('timestamp', 'min(timestamp) OVER (PARTITION BY site_id)', 90)} AS battery_pm_risk FROM battery_base))""")


@query("h8_base_risk", "energy_base", "SELECT site_id, timestamp, energy_base_risk FROM energy_base", "energy_base_risk")
def h8(spark, sf):
    return S.base_risk(S.energy_hourly(flagged(spark, sf), KEYS), KEYS, K.WEIGHTS["energy"],
                       "energy_base_risk").select("site_id", "timestamp", "energy_base_risk")


@query("h9_final_risk", "filled", """
SELECT site_id, timestamp, least(greatest(temperature * (1 + 0.5 * least(greatest(humidity_std_1h / 30, 0), 1)) * (1 + 0.3 * 0.4), 0), 100)
       * CASE WHEN temperature IS NULL THEN NULL ELSE 1 END AS risk FROM filled""", "risk")
def h9(spark, sf):
    return filled(spark, sf).select("site_id", "timestamp", S.final_risk(
        F.col("temperature"), F.col("humidity_std_1h") / 30, F.lit(0.4), 0.5, 0.3).alias("risk"))


def _domain_cols(d):
    return [f"{d}_base_risk", f"{d}_pm_risk", f"{d}_anomaly_burden", f"{d}_risk_score", f"{d}_health_score"]


def environment(spark, sf):
    hourly = S.environment_hourly(readings(spark, sf), KEYS, "ts", ["event_id"])
    return S.domain_scores(hourly, KEYS, "environmental", K.WEIGHTS["environmental"])


@query("h10_environment_scores", "env_scores", f"SELECT site_id, timestamp, {', '.join(_domain_cols('environmental'))} FROM env_scores",
       " ".join(_domain_cols("environmental")))
def h10_env(spark, sf):
    return environment(spark, sf).select("site_id", "timestamp", *_domain_cols("environmental"))


_E10 = [*_domain_cols("energy"), "energy_sequence_anomaly"]


@query("h10_energy_scores", "energy_scores", f"SELECT site_id, timestamp, {', '.join(_E10)} FROM energy_scores", " ".join(_E10))
def h10_energy(spark, sf):
    return S.domain_scores(S.energy_hourly(flagged(spark, sf), KEYS), KEYS, "energy", K.WEIGHTS["energy"]).select(
        "site_id", "timestamp", *_E10)


@query("h10_battery_scores", "battery_scores", f"SELECT site_id, timestamp, {', '.join(_domain_cols('battery'))} FROM battery_scores",
       " ".join(_domain_cols("battery")))
def h10_battery(spark, sf):
    return S.domain_scores(S.battery_hourly(flagged(spark, sf), KEYS), KEYS, "battery", K.WEIGHTS["battery"]).select(
        "site_id", "timestamp", *_domain_cols("battery"))


# --- calibration, overall score and reading aids ---------------------------------------
cte("calibrated", "energy_scores", """
SELECT *, CASE WHEN outage_duration_hours >= 4
               THEN greatest(soft, least(85 + 3 * greatest(outage_duration_hours - 4, 0), 100)) ELSE soft END AS calibrated
FROM (SELECT *, 100 * (1 - exp(-energy_risk_score / 60.0)) AS soft FROM energy_scores)""")


@query("h11_calibrate_energy", "calibrated", """
SELECT site_id, timestamp, energy_risk_score AS energy_risk_score_raw, calibrated AS energy_risk_score,
       100 - calibrated AS energy_health_score FROM calibrated""", "energy_risk_score_raw energy_risk_score energy_health_score")
def h11(spark, sf):
    scored = S.domain_scores(S.energy_hourly(flagged(spark, sf), KEYS), KEYS, "energy", K.WEIGHTS["energy"])
    return S.calibrate_energy(scored).select("site_id", "timestamp", "energy_risk_score_raw", "energy_risk_score",
                                             "energy_health_score")


cte("joined", "env_scores calibrated battery_scores", """
SELECT e.* EXCLUDE (environmental_risk_score), coalesce(environmental_risk_score, 0) AS environmental_risk_score,
       environmental_risk_score IS NULL AS environment_missing, c.calibrated AS energy_risk_score, 100 - c.calibrated AS energy_health_score,
       c.energy_base_risk, c.energy_pm_risk, c.energy_anomaly_burden, c.outage_duration_hours,
       b.battery_risk_score, b.battery_health_score, b.battery_base_risk, b.battery_pm_risk, b.battery_anomaly_burden,
       b.battery_alarm_duration_hours
FROM env_scores e JOIN calibrated c ON c.site_id = e.site_id AND c.timestamp = e.timestamp
JOIN battery_scores b ON b.site_id = e.site_id AND b.timestamp = e.timestamp""")
cte("overall0", "joined", """
SELECT *, 0.30 * environmental_risk_score AS c1, 0.35 * energy_risk_score AS c2, 0.35 * battery_risk_score AS c3,
       least(0.30 * environmental_risk_score + 0.35 * energy_risk_score + 0.35 * battery_risk_score, 100) AS overall_site_risk FROM joined""")
cte("overall", "overall0", """
SELECT *, 100 - overall_site_risk AS overall_site_health,
       CASE WHEN overall_site_risk < 5 THEN 'None' WHEN c1 >= c2 AND c1 >= c3 THEN 'Environmental' WHEN c2 >= c3 THEN 'Energy'
            ELSE 'Battery' END AS main_risk_driver,
       CASE WHEN overall_site_risk = 0 THEN 0 ELSE least(greatest(c1, c2, c3) / overall_site_risk, 1) END AS main_driver_share FROM overall0""")


def _site_tv(c):
    o = "OVER (PARTITION BY site_id ORDER BY timestamp"
    return f"{c} - lag({c}, 24) {o}) AS {c}_trend_24h"


cte("scored0", "overall", f"""
SELECT *, {_site_tv('overall_site_health')}, {_site_tv('environmental_health_score')}, {_site_tv('energy_health_score')},
       {_site_tv('battery_health_score')},
       CASE WHEN count(*) OVER d >= 6 THEN stddev_samp(overall_site_health) OVER d END AS overall_site_health_volatility_24h,
       avg(overall_site_health) OVER (PARTITION BY site_id ORDER BY timestamp ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)
         AS overall_site_health_smoothed
FROM overall WINDOW d AS (PARTITION BY site_id ORDER BY timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
_ADV = S.ADVICE
cte("scored", "scored0", f"""
SELECT *, CASE WHEN overall_site_health < 40 THEN 'Critical' WHEN overall_site_health < 60 THEN 'High Risk'
            WHEN overall_site_health < 75 THEN 'Warning' WHEN overall_site_health < 90 THEN 'Minor Degradation' ELSE 'Healthy' END AS site_health_status,
       CASE WHEN overall_site_health < 40 THEN 'P1 - Immediate' WHEN overall_site_health < 60 THEN 'P2 - Urgent'
            WHEN overall_site_health < 75 THEN 'P3 - Investigate' WHEN overall_site_health < 90 THEN 'P4 - Monitor' ELSE 'P5 - Routine' END AS maintenance_priority,
       CASE WHEN overall_site_health_trend_24h <= -15 THEN 'Rapidly Deteriorating' WHEN overall_site_health_trend_24h <= -5 THEN 'Deteriorating'
            WHEN overall_site_health_trend_24h >= 15 THEN 'Rapidly Improving' WHEN overall_site_health_trend_24h >= 5 THEN 'Improving'
            ELSE 'Stable' END AS health_trend_status,
       CASE WHEN overall_site_health >= 90 THEN '{_ADV["routine"]}'
            WHEN main_risk_driver = 'Battery' THEN CASE WHEN battery_alarm_duration_hours >= 12 THEN '{_ADV["battery_urgent"]}'
                 WHEN battery_alarm_duration_hours >= 4 THEN '{_ADV["battery_check"]}' ELSE '{_ADV["battery_review"]}' END
            WHEN main_risk_driver = 'Energy' THEN CASE WHEN outage_duration_hours >= 4 THEN '{_ADV["energy_urgent"]}'
                 WHEN outage_duration_hours >= 1 THEN '{_ADV["energy_check"]}' ELSE '{_ADV["energy_review"]}' END
            WHEN main_risk_driver = 'Environmental' THEN CASE WHEN temperature > 30 THEN '{_ADV["cooling"]}'
                 WHEN humidity < 35 OR humidity > 60 THEN '{_ADV["humidity"]}' ELSE '{_ADV["ambient"]}' END
            ELSE '{_ADV["review"]}' END AS recommended_action,
       (100 - CASE WHEN observation_count < 10 THEN 15 ELSE 0 END - CASE WHEN humidity IS NULL THEN 20 ELSE 0 END)::DOUBLE AS score_confidence
FROM scored0""")


def scored(spark, sf):
    return S.health_scores(readings(spark, sf), alarms(spark, sf), KEYS, reading_order=["event_id"])


def gold_hourly(spark, sf):
    """The hourly score table as its readers meet it: computed once and materialised."""
    keep = ["overall_site_health", *K.SUBSYSTEM_HEALTH, "main_risk_driver", "overall_site_health_trend_24h",
            *[f"{c}_trend_24h" for c in K.SUBSYSTEM_HEALTH]]
    return durable_checkpoint(scored(spark, sf).select("site_id", "timestamp", *keep))


_H12 = "overall_site_risk overall_site_health main_driver_share"


@query("h12_overall_health", "overall", f"""
SELECT site_id, timestamp, main_risk_driver, environment_missing, {', '.join(_H12.split())} FROM overall""", _H12)
def h12(spark, sf):
    return scored(spark, sf).select("site_id", "timestamp", "main_risk_driver", "environment_missing", *_H12.split())


@query("h13_status_priority", "filled", """
SELECT site_id, timestamp, CASE WHEN x < 40 THEN 'Critical' WHEN x < 60 THEN 'High Risk' WHEN x < 75 THEN 'Warning'
       WHEN x < 90 THEN 'Minor Degradation' ELSE 'Healthy' END AS site_health_status,
       CASE WHEN x < 40 THEN 'P1 - Immediate' WHEN x < 60 THEN 'P2 - Urgent' WHEN x < 75 THEN 'P3 - Investigate'
            WHEN x < 90 THEN 'P4 - Monitor' ELSE 'P5 - Routine' END AS maintenance_priority
FROM (SELECT *, coalesce(humidity, 95) AS x FROM filled)""")
def h13(spark, sf):
    rows = filled(spark, sf).withColumn("x", F.coalesce("humidity", F.lit(95.0)))
    return S.status_priority(rows, "x").select("site_id", "timestamp", "site_health_status", "maintenance_priority")


@query("h14_trend_label", "readings", """
SELECT event_id, CASE WHEN x <= -15 THEN 'Rapidly Deteriorating' WHEN x <= -5 THEN 'Deteriorating' WHEN x >= 15 THEN 'Rapidly Improving'
       WHEN x >= 5 THEN 'Improving' ELSE 'Stable' END AS health_trend_status FROM (SELECT event_id, temperature - 30 AS x FROM readings)""")
def h14(spark, sf):
    return S.trend_label(readings(spark, sf).withColumn("x", F.col("temperature") - 30), "x").select(
        "event_id", "health_trend_status")


@query("h15_recommend", "scored", "SELECT site_id, timestamp, recommended_action FROM scored")
def h15(spark, sf):
    return scored(spark, sf).select("site_id", "timestamp", "recommended_action")


@query("h16_confidence", "filled", """
SELECT site_id, timestamp, (100 - CASE WHEN observation_count < 10 THEN 15 ELSE 0 END
       - CASE WHEN humidity IS NULL THEN 20 ELSE 0 END)::DOUBLE AS score_confidence FROM filled""", "score_confidence")
def h16(spark, sf):
    return S.confidence(filled(spark, sf)).select("site_id", "timestamp", "score_confidence")


_H17 = ("overall_site_health overall_site_risk environmental_health_score energy_health_score battery_health_score "
        "environmental_risk_score energy_risk_score battery_risk_score environmental_anomaly_burden energy_anomaly_burden "
        "battery_anomaly_burden overall_site_health_trend_24h overall_site_health_volatility_24h overall_site_health_smoothed "
        "temperature humidity score_confidence main_driver_share")
_H17S = ("main_risk_driver site_health_status maintenance_priority health_trend_status recommended_action "
         "outage_duration_hours battery_alarm_duration_hours observation_count")


@query("h17_health_scores", "scored", f"SELECT site_id, timestamp, {', '.join((_H17 + ' ' + _H17S).split())} FROM scored", _H17)
def h17(spark, sf):
    return scored(spark, sf).select("site_id", "timestamp", *_H17.split(), *_H17S.split())


def _api(s):
    return f"CASE WHEN {s} >= 90 THEN 'healthy' WHEN {s} >= 60 THEN 'watch' ELSE 'critical' END"


cte("last_hour", "scored", "SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY timestamp DESC) = 1")
cte("snapshot", "last_hour", "SELECT *, " + _api("score") + """ AS status,
       CASE WHEN change >= 5 THEN 'up' WHEN change <= -5 THEN 'down' ELSE 'stable' END AS trend FROM (""" + " UNION ALL ".join(
    f"SELECT site_id, timestamp, '{'global' if n == 'global' else 'family'}' AS scope, "
    f"{'CAST(NULL AS VARCHAR)' if n == 'global' else repr(n)} AS family, round_even({c} * 10, 0) / 10 AS score, {c}_trend_24h AS change FROM last_hour"
    for n, c in {"global": "overall_site_health", **{c.split('_')[0]: c for c in K.SUBSYSTEM_HEALTH}}.items()) + ")")


@query("h18_snapshot", "snapshot", "SELECT * EXCLUDE (change) FROM snapshot", "score")
def h18(spark, sf):
    return S.snapshot(gold_hourly(spark, sf), KEYS)
