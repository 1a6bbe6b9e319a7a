"""E1-E6, W13, A7-A9, A13, C11, J5, X3, T3, U1, U2 on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import constants as K
from ...operators import aggregates as A
from ...operators import cleaning as C
from ...operators import episodes as E
from ...operators import hourgrid as H
from ...operators import quantiles as Q
from ...operators import segments as G
from ...session import durable_checkpoint
from .base import EXIT_REACH, GAP, KEYS, alarms, block, cte, query, readings, table
from .segments import hysteresis_sql, segmented, with_bounds

NAMES = ["mild_lower", "mild_upper", "extreme_lower", "extreme_upper"]

# hot runs (G4) with their site's bounds
cte("hot_runs", "runs1 tukey_t", """
SELECT r.*, mild_lower, mild_upper, extreme_lower, extreme_upper, CAST(sum(opens) OVER (PARTITION BY site_id ORDER BY ts
       ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM runs1 r JOIN tukey_t USING (site_id)""")
_CHARACTER = """
SELECT {keys}, start, CASE WHEN high THEN 'high' ELSE 'low' END AS direction, CASE WHEN high THEN hi ELSE lo END AS peak_value,
       CASE WHEN (high AND hi >= eu) OR (NOT high AND lo <= el) THEN 'critical' ELSE 'alert' END AS severity,
       greatest((epoch_us(finish) - epoch_us(start)) / 60000000.0, 2.0) AS duration_min
FROM (SELECT *, hi >= mu AND (lo > ml OR hi - mu >= ml - lo) AS high
      FROM (SELECT {keys}, min(ts) AS start, max(ts) AS finish, min(temperature) AS lo, max(temperature) AS hi, max(mild_lower) AS ml,
                   max(mild_upper) AS mu, max(extreme_lower) AS el, max(extreme_upper) AS eu FROM {src} GROUP BY {keys})
      WHERE hi >= mu OR lo <= ml)"""


@query("e1_characterise_runs", "hot_runs", _CHARACTER.format(keys="site_id, run_id", src="(SELECT * FROM hot_runs WHERE hot)"),
       "peak_value duration_min")
def e1(spark, sf):
    bounds = Q.tukey(readings(spark, sf), KEYS, "temperature").select(*KEYS, *NAMES)
    rows = segmented(spark, sf).withColumn("hot", F.col("temperature") >= 60)
    runs = G.add_runs(rows, KEYS, "ts", "hot", block_seconds=block(spark, sf)).filter("hot").join(bounds, KEYS)
    return E.characterise_runs(runs, ["site_id", "run_id"], "ts", "temperature", {n: n for n in NAMES})


_AGE = ("CASE WHEN epoch_us({ref}) - epoch_us({at}) > 72 * 3600000000 THEN 'resolved' "
        "WHEN epoch_us({ref}) - epoch_us({at}) > 24 * 3600000000 THEN 'acknowledged' ELSE 'open' END")


@query("e2_age_status", "readings bounds", f"""
SELECT event_id, {_AGE.format(ref='last_ts', at='ts')} AS status FROM readings JOIN bounds USING (site_id)""")
def e2(spark, sf):
    r = readings(spark, sf)
    ref = H.observation_bounds(r, KEYS, "ts").select("site_id", "last_ts")
    return r.join(ref, KEYS).select("event_id", E.age_status("ts", "last_ts").alias("status"))


# the flagship: threshold episodes by hysteresis
cte("inside", "rec_hyst seg_t", """
SELECT s.*, h.episode_id FROM seg_t s JOIN rec_hyst h ON h.rn > 0 AND h.event_id = s.event_id WHERE h.episode_id > 0""")
cte("episode_runs", "inside", _CHARACTER.format(keys="site_id, episode_id", src="inside"))
cte("episodes", "episode_runs bounds", f"""
SELECT printf('EP-%04d', row_number() OVER (PARTITION BY site_id ORDER BY start)) AS id, site_id,
       'U' || CAST(site_id AS VARCHAR) AS equipment, 'collective' AS type, severity, direction, start,
       round_even(duration_min * 10, 0) / 10 AS duration_min, round_even(peak_value * 100, 0) / 100 AS peak_value,
       {_AGE.format(ref='last_ts', at='start')} AS status, 'environment' AS dimension
FROM episode_runs JOIN bounds USING (site_id)""")


def episodes(spark, sf):
    # the segmented (silver) series has several readers, so it is materialised once
    r = durable_checkpoint(segmented(spark, sf).select(
        "site_id", "event_id", "ts", "temperature", "segment_id", "segment_position"))
    rows = r.withColumn("temperature", F.when(F.col("event_id") % 29 != 0, F.col("temperature")))
    return E.threshold_episodes(
        rows, KEYS, "ts", "temperature", Q.tukey(r, KEYS, "temperature"),
        H.observation_bounds(r, KEYS, "ts"), F.concat(F.lit("U"), F.col("site_id")),
        max_gap=GAP, block_seconds=block(spark, sf, EXIT_REACH))


@query("e4_threshold_episodes", "episodes", "SELECT * FROM episodes", "duration_min peak_value")
def e4(spark, sf):
    return episodes(spark, sf)


@query("e6_refresh_status", "episodes", f"""
SELECT id, site_id, {_AGE.format(ref="TIMESTAMP '2024-01-20 12:00:00'", at='start')} AS status FROM episodes""")
def e6(spark, sf):
    return E.refresh_status(episodes(spark, sf), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")).select(
        "id", "site_id", "status")


@query("w13_number_episodes", "alarms", """
SELECT event_id, site_id, printf('EP-%04d', row_number() OVER (PARTITION BY site_id ORDER BY log_time, event_id)) AS id
FROM alarms""")
def w13(spark, sf):
    rows = alarms(spark, sf).select("event_id", "site_id", "log_time")
    return E.number_episodes(rows, KEYS, "log_time", ties=["event_id"]).drop("log_time")


# episode-shaped table straight from the events: several equipments, types and dimensions
cte("eps", "", """
SELECT printf('EV-%05d', event_id) AS id, user_id % 4 AS site_id, CASE WHEN user_id % 9 = 0 THEN 'room' ELSE 'U' || CAST(user_id % 14 AS VARCHAR) END AS equipment,
       CASE event_type WHEN 'view' THEN 'duration' WHEN 'click' THEN 'sequence' ELSE 'collective' END AS type,
       CASE WHEN value >= 70 THEN 'critical' ELSE 'alert' END AS severity, CASE WHEN event_id % 3 = 0 THEN 'low' ELSE 'high' END AS direction,
       ts AS start, value AS duration_min, value AS peak_value,
       CASE event_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'acknowledged' ELSE 'resolved' END AS status,
       CASE WHEN event_type = 'error' THEN 'scada' ELSE 'environment' END AS dimension
FROM events""")


def eps(spark, sf):
    n, u, t = F.col("event_id"), F.col("user_id"), F.col("event_type")
    return table(spark, sf, "events").select(
        F.format_string("EV-%05d", n).alias("id"), (u % 4).alias("site_id"),
        F.when(u % 9 == 0, "room").otherwise(F.concat(F.lit("U"), u % 14)).alias("equipment"),
        F.when(t == "view", "duration").when(t == "click", "sequence").otherwise("collective").alias("type"),
        F.when(F.col("value") >= 70, "critical").otherwise("alert").alias("severity"),
        F.when(n % 3 == 0, "low").otherwise("high").alias("direction"), F.col("ts").alias("start"),
        F.col("value").alias("duration_min"), F.col("value").alias("peak_value"),
        F.when(n % 4 == 0, "open").when(n % 4 == 1, "acknowledged").otherwise("resolved").alias("status"),
        F.when(t == "error", "scada").otherwise("environment").alias("dimension"))


def units(spark, sf):
    """Equipment dimension: U0..U13 in three families, the room sensor counted as cooling."""
    u = table(spark, sf, "nation").filter("n_nationkey < 13").select(
        F.concat(F.lit("U"), F.col("n_nationkey")).alias("unit"),
        F.when(F.col("n_nationkey") < 10, "cooling").when(F.col("n_nationkey") < 12, "ups")
        .otherwise("generator").alias("family"))
    room = table(spark, sf, "nation").filter("n_nationkey = 0").select(
        F.lit("room").alias("unit"), F.lit("cooling").alias("family"))
    return u.unionByName(room)


cte("units", "", """
SELECT 'U' || CAST(n_nationkey AS VARCHAR) AS unit, CASE WHEN n_nationkey < 10 THEN 'cooling' WHEN n_nationkey < 12 THEN 'ups' ELSE 'generator' END AS family
FROM nation WHERE n_nationkey < 13 UNION ALL SELECT 'room', 'cooling' FROM nation WHERE n_nationkey = 0""")


@query("c11_filter_episodes", "eps", """
SELECT id, start FROM eps WHERE equipment = 'U3' AND severity = 'alert' AND start BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'""")
def c11(spark, sf):
    return C.filter_episodes(eps(spark, sf), equipment="U3", severity="alert", start="2024-01-05 00:00:00",
                             end="2024-01-25 00:00:00").select("id", "start")


_TALLY = ", ".join(f"count(*) FILTER (WHERE {c} = '{v}') AS {c}_{v}" for c, vs in E.EPISODE_VALUES.items() for v in vs)
_STATS = f"""
SELECT site_id, count(*) AS total, round_even(100 * sum(duration_min) / greatest(span_days * 24 * 60, 1) * 100, 0) / 100 AS anomaly_rate_pct,
       round_even(CASE WHEN count(*) > 1 THEN (epoch_us(max(start)) - epoch_us(min(start))) / 3600000000.0 / (count(*) - 1) ELSE 0 END * 10, 0) / 10 AS mtba_hours,
       {_TALLY}, any_value(equipment_top) AS top_equipment, CAST(any_value(n_top) AS BIGINT) AS top_equipment_count
FROM {{src}} JOIN bounds USING (site_id)
JOIN (SELECT * FROM (SELECT site_id, equipment AS equipment_top, count(*) AS n_top FROM {{src}} GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY n_top DESC, equipment_top) = 1) USING (site_id)
GROUP BY site_id, span_days"""


@query("a7_episode_stats", "eps bounds", _STATS.format(src="eps"), "anomaly_rate_pct mtba_hours")
def a7(spark, sf):
    span = H.observation_bounds(readings(spark, sf), KEYS, "ts").select("site_id", "span_days")
    rows = eps(spark, sf)
    return E.episode_stats(rows.join(span, KEYS), F.col("span_days"), ["site_id", "span_days"]).drop("span_days")


def _hist(bucket):
    step = {"day": "1 DAY", "week": "7 DAY", "month": "1 MONTH"}[bucket]
    return f"""
SELECT s.site_id, CAST(s.p AS DATE) AS period_start, coalesce(total, 0) AS total, coalesce(a, 0) AS severity_alert, coalesce(c, 0) AS severity_critical
FROM (SELECT site_id, unnest(generate_series(min(date_trunc('{bucket}', start)::TIMESTAMP), max(date_trunc('{bucket}', start)::TIMESTAMP), INTERVAL {step})) AS p
      FROM eps GROUP BY site_id) s
LEFT JOIN (SELECT site_id, date_trunc('{bucket}', start)::TIMESTAMP AS p, count(*) AS total, count(*) FILTER (WHERE severity = 'alert') AS a,
                  count(*) FILTER (WHERE severity = 'critical') AS c FROM eps GROUP BY ALL) h ON h.site_id = s.site_id AND h.p = s.p"""


for _b in ("day", "week", "month"):
    @query(f"a8_histogram_{_b}", "eps", _hist(_b))
    def a8(spark, sf, bucket=_b):
        return E.episode_histogram(eps(spark, sf), bucket, KEYS)


@query("j7_spine_join", "eps", _hist("day"))
def j7(spark, sf):
    rows = eps(spark, sf)
    counts = rows.groupBy("site_id", F.to_date("start").alias("period_start")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "alert").alias("severity_alert"),
        F.count_if(F.col("severity") == "critical").alias("severity_critical"))
    return H.spine_join(counts, KEYS, "period_start", "day", ["total", "severity_alert", "severity_critical"])


def _window(hours):
    return f"""
SELECT b.site_id, last_ts AS reference_at, count(*) FILTER (WHERE cur) AS total, count(*) FILTER (WHERE prev) AS previous_total,
       round_even(100 * coalesce(sum(duration_min) FILTER (WHERE cur), 0) / ({hours} * 60) * 100, 0) / 100 AS rate_pct,
       any_value(t.family) AS top_family, coalesce(any_value(t.n), 0)::BIGINT AS top_family_count,
       count(*) FILTER (WHERE cur AND dimension = 'environment') AS dimension_environment,
       count(*) FILTER (WHERE cur AND dimension = 'scada') AS dimension_scada
FROM bounds b LEFT JOIN (SELECT *, start <= ref AND start >= ref - INTERVAL {hours} HOUR AS cur,
        start < ref - INTERVAL {hours} HOUR AND start >= ref - INTERVAL {2 * hours} HOUR AS prev
     FROM eps JOIN (SELECT site_id, last_ts AS ref FROM bounds) USING (site_id)) e ON e.site_id = b.site_id
LEFT JOIN (SELECT * FROM (SELECT e.site_id, coalesce(family, 'unknown') AS family, count(*) AS n FROM eps e JOIN bounds b ON b.site_id = e.site_id
        LEFT JOIN units ON unit = equipment WHERE start <= last_ts AND start >= last_ts - INTERVAL {hours} HOUR GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY n DESC, family) = 1) t ON t.site_id = b.site_id
GROUP BY b.site_id, last_ts"""


for _w, _h in (("24h", 24), ("7d", 168)):
    @query(f"a9_window_stats_{_w}", "eps units bounds", _window(_h), "rate_pct")
    def a9(spark, sf, hours=_h):
        return E.window_stats(eps(spark, sf), hours, H.observation_bounds(readings(spark, sf), KEYS, "ts"),
                              units(spark, sf), KEYS)


@query("a13_status_counts", "eps", "SELECT status, count(*) AS n FROM eps GROUP BY status")
def a13(spark, sf):
    return A.status_counts(eps(spark, sf))


cte("actions", "eps", """
SELECT id, CASE WHEN site_id = 0 THEN 'resolved' ELSE 'acknowledged' END AS status FROM eps WHERE direction = 'low' AND peak_value > 50""")


def actions(spark, sf):
    return eps(spark, sf).filter("direction = 'low' AND peak_value > 50").select(
        "id", F.when(F.col("site_id") == 0, "resolved").otherwise("acknowledged").alias("status"))


@query("j5_apply_overrides", "eps actions", """
SELECT e.id, coalesce(a.status, e.status) AS status FROM eps e LEFT JOIN actions a ON a.id = e.id""")
def j5(spark, sf):
    return E.apply_overrides(eps(spark, sf), actions(spark, sf)).select("id", "status")


@query("x3_shift_time", "eps", """
SELECT id, start + delta AS start, least(fin + delta, TIMESTAMP '2026-05-01 10:00:00') AS fin
FROM (SELECT id, start, start + INTERVAL 2 DAY AS fin, TIMESTAMP '2026-05-01 10:00:00' - (SELECT date_trunc('hour', max(start)) FROM eps) AS delta FROM eps)""")
def x3(spark, sf):
    rows = eps(spark, sf).select("id", "start", (F.col("start") + F.expr("interval 2 days")).alias("fin"))
    now = F.lit("2026-05-01 10:40:00").cast("timestamp_ntz")
    anchor = rows.agg(F.date_trunc("hour", F.max("start")).cast("timestamp_ntz").alias("_a")).select(
        E.anchor_delta(now, "_a").alias("_d"))
    return E.shift_time(rows.withColumn("_d", anchor.scalar()), ["start", "fin"], F.col("_d"), clamp={
        "fin": F.lit("2026-05-01 10:00:00").cast("timestamp_ntz")}).drop("_d")


@query("t3_top_contributor", None, """
SELECT l_returnflag, l_suppkey, n FROM (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_suppkey) = 1""")
def t3(spark, sf):
    return A.top_contributor(table(spark, sf, "lineitem"), "l_suppkey", ["l_returnflag"])


@query("u1_union_all", "eps readings", """
SELECT site_id, start AS at, peak_value AS v FROM eps UNION ALL SELECT site_id, ts, temperature FROM readings""", "v")
def u1(spark, sf):
    a = eps(spark, sf).select("site_id", F.col("start").alias("at"), F.col("peak_value").alias("v"))
    return A.union_all(a, readings(spark, sf).select("site_id", F.col("ts").alias("at"), F.col("temperature").alias("v")))


@query("u2_distinct", "eps", "SELECT DISTINCT equipment, CAST(start AS DATE) AS day FROM eps")
def u2(spark, sf):
    return A.distinct_values(eps(spark, sf).withColumn("day", F.to_date("start")), ["equipment", "day"])


@query("a16_distinct_units", "eps", "SELECT DISTINCT equipment FROM eps")
def a16_units(spark, sf):
    return A.distinct_values(eps(spark, sf), ["equipment"])


@query("a16_recent", "eps", "SELECT id, start FROM eps ORDER BY start DESC, id LIMIT 25")
def a16_recent(spark, sf):
    return A.recent(eps(spark, sf).select("id", "start"), "start", 25, ["id"])


@query("a6_state_stats", "readings tukey_t tukey_h", """
SELECT r.site_id, event_id % 5 AS state, count(*) AS n_points, avg(CAST(temperature >= t.mild_upper AS INTEGER)) AS prop_temperature_high,
       avg(CAST(temperature <= t.mild_lower AS INTEGER)) AS prop_temperature_low, avg(CAST(coalesce(humidity >= h.mild_upper, false) AS INTEGER)) AS prop_humidity_high,
       avg(CAST(coalesce(humidity <= h.mild_lower, false) AS INTEGER)) AS prop_humidity_low
FROM readings r JOIN tukey_t t USING (site_id) JOIN tukey_h h USING (site_id) GROUP BY ALL""",
       "prop_temperature_high prop_temperature_low prop_humidity_high prop_humidity_low")
def a6(spark, sf):
    r = readings(spark, sf)
    t = Q.tukey(r, KEYS, "temperature").select("site_id", F.col("mild_lower").alias("tl"), F.col("mild_upper").alias("tu"))
    h = Q.tukey(r, KEYS, "humidity").select("site_id", F.col("mild_lower").alias("hl"), F.col("mild_upper").alias("hu"))
    rows = r.withColumn("state", F.col("event_id") % 5).join(t, KEYS).join(h, KEYS)
    return A.state_stats(rows, "state", KEYS, {"temperature": ("tl", "tu"), "humidity": ("hl", "hu")})
