"""G1-G8 on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import quantiles as Q
from ...operators import segments as G
from .base import EXIT_REACH, GAP, KEYS, alarms, block, cte, query, readings

cte("seg0", "readings", """
SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000
               THEN 1 ELSE 0 END AS opens
FROM readings WINDOW w AS (PARTITION BY site_id ORDER BY ts)""")
cte("seg1", "seg0", """
SELECT *, CAST(sum(opens) OVER (PARTITION BY site_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id
FROM seg0""")
cte("seg", "seg1", """
SELECT event_id, site_id, ts, temperature, humidity, opens = 1 AS is_discontinuity, segment_id,
       row_number() OVER (PARTITION BY site_id, segment_id ORDER BY ts) - 1 AS segment_position,
       min(ts) OVER (PARTITION BY site_id, segment_id) AS segment_start
FROM seg1""")


def segmented(spark, sf):
    return G.add_segments(readings(spark, sf), KEYS, "ts", GAP, block(spark, sf))


@query("g1_add_segments", "seg", "SELECT * FROM seg", "temperature humidity")
def g1(spark, sf):
    return segmented(spark, sf)


cte("kept", "seg", "SELECT * FROM seg WHERE event_id % 4 <> 0")
cte("seqa", "kept", """
SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000
                 OR lag(segment_id) OVER w <> segment_id THEN 1 ELSE 0 END AS opens
FROM kept WINDOW w AS (PARTITION BY site_id ORDER BY ts)""")
cte("seqb", "seqa", """
SELECT *, sum(opens) OVER (PARTITION BY site_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS raw_id FROM seqa""")
cte("seqc", "seqb", "SELECT *, count(*) OVER (PARTITION BY site_id, raw_id) AS n FROM seqb")


@query("g2_add_sequences", "seqc", """
SELECT event_id, site_id, dense_rank() OVER (PARTITION BY site_id ORDER BY raw_id) AS sequence_id,
       row_number() OVER (PARTITION BY site_id, raw_id ORDER BY ts) - 1 AS sequence_position
FROM seqc WHERE n >= 2""")
def g2(spark, sf):
    rows = segmented(spark, sf).withColumn(
        "temperature", F.when(F.col("event_id") % 4 != 0, F.col("temperature")))
    return G.add_sequences(rows, KEYS, "ts", ["temperature"], GAP, block_seconds=block(spark, sf, 2 * GAP)).select(
        "event_id", "site_id", "sequence_id", "sequence_position")


cte("event0", "alarms", """
SELECT *, CASE WHEN epoch_us(log_time) - epoch_us(lag(log_time) OVER w) > 1800000000 THEN 1 ELSE 0 END AS opens
FROM alarms WINDOW w AS (PARTITION BY site_id ORDER BY log_time, event_id)""")
cte("alarm_events", "event0", """
SELECT *, CAST(sum(opens) OVER (PARTITION BY site_id ORDER BY log_time, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
         AS alarm_event FROM event0""")


def alarm_events(spark, sf):
    return G.add_events(alarms(spark, sf).withColumnRenamed("event_id", "row_id"), KEYS, "log_time",
                        1800.0, ties=["row_id"]).withColumnsRenamed(
        {"event_id": "alarm_event", "row_id": "event_id"})


@query("g3_add_events", "alarm_events", "SELECT event_id, site_id, alarm_event FROM alarm_events")
def g3(spark, sf):
    return alarm_events(spark, sf).select("event_id", "site_id", "alarm_event")


cte("runs0", "seg", "SELECT *, temperature >= 60 AS hot FROM seg")
cte("runs1", "runs0", """
SELECT *, CASE WHEN lag(hot) OVER w IS NULL OR lag(hot) OVER w <> hot OR lag(segment_id) OVER w <> segment_id
               THEN 1 ELSE 0 END AS opens FROM runs0 WINDOW w AS (PARTITION BY site_id ORDER BY ts)""")


@query("g4_add_runs", "runs1", """
SELECT event_id, site_id, hot, CAST(sum(opens) OVER (PARTITION BY site_id ORDER BY ts ROWS UNBOUNDED PRECEDING)
       AS BIGINT) AS run_id FROM runs1""")
def g4(spark, sf):
    rows = segmented(spark, sf).withColumn("hot", F.col("temperature") >= 60)
    return G.add_runs(rows, KEYS, "ts", "hot", block_seconds=block(spark, sf)).select(
        "event_id", "site_id", "hot", "run_id")


# --- Tukey bounds and hysteresis ----------------------------------------------------------
def _tukey(col, name):
    cte(name, "readings", f"""
SELECT site_id, q1, q3, iqr, q1 - 0.5 * iqr AS mild_lower, q3 + 0.5 * iqr AS mild_upper,
       q1 - iqr AS strong_lower, q3 + iqr AS strong_upper,
       q1 - 1.5 * iqr AS extreme_lower, q3 + 1.5 * iqr AS extreme_upper
FROM (SELECT *, q3 - q1 AS iqr FROM (SELECT site_id, quantile_cont({col}, 0.25) AS q1,
      quantile_cont({col}, 0.75) AS q3 FROM readings GROUP BY site_id))""")


_tukey("temperature", "tukey_t")
_tukey("humidity", "tukey_h")
_BOUNDS = "q1 q3 iqr mild_lower mild_upper strong_lower strong_upper extreme_lower extreme_upper"


@query("a5_tukey", "tukey_t", "SELECT * FROM tukey_t", _BOUNDS)
def a5(spark, sf):
    return Q.tukey(readings(spark, sf), KEYS, "temperature")


@query("a5_tukey_lineitem", None, """
SELECT l_returnflag, q1, q3, q3 - q1 AS iqr FROM (SELECT l_returnflag,
  quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3
  FROM lineitem GROUP BY l_returnflag)""", "q1 q3 iqr")
def a5_lineitem(spark, sf):
    from .base import table
    rows = table(spark, sf, "lineitem")
    return Q.quantile_columns(rows, ["l_returnflag"], "l_extendedprice", {"q1": 0.25, "q3": 0.75}).withColumn("iqr", F.col("q3") - F.col("q1"))


def hysteresis_sql(name, source, value, enter, leave, high=True):
    """The state machine, one reading at a time."""
    up, down = ("v >= enter", "v <= leave") if high else ("v <= enter", "v >= leave")
    cte(f"{name}_in", source, f"""
SELECT event_id, site_id, segment_id, row_number() OVER (PARTITION BY site_id ORDER BY ts) AS rn,
       {value} AS v, {enter} AS enter, {leave} AS leave FROM {source.split()[-1]}""")
    cte(f"rec_{name}", f"{name}_in", f"""
SELECT DISTINCT site_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS seg,
       false AS active, 0 AS left_rows, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS episode_id FROM {name}_in
UNION ALL
SELECT site_id, event_id, rn, segment_id, inside AND k < 5, CASE WHEN inside AND k < 5 THEN k ELSE 0 END,
       n + fresh, CASE WHEN inside THEN n + fresh ELSE 0 END
FROM (SELECT *, CASE WHEN inside AND {down} THEN base + 1 ELSE 0 END AS k
      FROM (SELECT h.*, r.n, CASE WHEN r.active AND r.seg = h.segment_id THEN r.left_rows ELSE 0 END AS base,
                   CASE WHEN v IS NOT NULL AND NOT (r.active AND r.seg = h.segment_id) AND {up} THEN 1 ELSE 0 END AS fresh,
                   v IS NOT NULL AND ((r.active AND r.seg = h.segment_id) OR {up}) AS inside
            FROM rec_{name} r JOIN {name}_in h ON h.site_id = r.site_id AND h.rn = r.rn + 1))""")


cte("seg_t", "seg tukey_t", """
SELECT s.* REPLACE (CASE WHEN event_id % 29 <> 0 THEN temperature END AS temperature), mild_upper, mild_lower,
       extreme_upper, extreme_lower FROM seg s JOIN tukey_t USING (site_id)""")
hysteresis_sql("hyst", "seg_t", "temperature", "mild_upper", "mild_upper - 0.5")


def with_bounds(spark, sf):
    """Segmented readings (some missing) with their site's Tukey bounds."""
    bounds = Q.tukey(readings(spark, sf), KEYS, "temperature").select(
        *KEYS, "mild_lower", "mild_upper", "extreme_lower", "extreme_upper")
    value = F.when(F.col("event_id") % 29 != 0, F.col("temperature"))
    return segmented(spark, sf).withColumn("temperature", value).join(bounds, KEYS)


@query("g5_hysteresis", "rec_hyst", "SELECT event_id, site_id, episode_id FROM rec_hyst WHERE rn > 0")
def g5(spark, sf):
    rows = with_bounds(spark, sf).withColumn("leave", F.col("mild_upper") - 0.5)
    return G.hysteresis(rows, KEYS, "ts", "temperature", "mild_upper", "leave", max_gap=GAP,
                        block_seconds=block(spark, sf, EXIT_REACH)).select("event_id", "site_id", "episode_id")


for _side, _value, _margin, _high in (("th", "temperature", 0.5, True), ("tl", "temperature", 0.5, False),
                                      ("hh", "humidity", 2.0, True), ("hl", "humidity", 2.0, False)):
    _edge = {"temperature": (70, 12), "humidity": (80, 20)}[_value][0 if _high else 1]
    hysteresis_sql(_side, "seg", _value, f"{_edge}.0", f"{_edge - _margin if _high else _edge + _margin}", _high)


@query("g8_threshold_labels", "rec_th rec_tl rec_hh rec_hl", """
SELECT event_id, a AS target_temperature_high, b AS target_temperature_low, c AS target_humidity_high,
       d AS target_humidity_low, greatest(a, b, c, d) AS target_any FROM (
  SELECT t.event_id, CAST(t.episode_id > 0 AS INTEGER) AS a, CAST(u.episode_id > 0 AS INTEGER) AS b,
         CAST(x.episode_id > 0 AS INTEGER) AS c, CAST(y.episode_id > 0 AS INTEGER) AS d
  FROM rec_th t JOIN rec_tl u USING (site_id, rn) JOIN rec_hh x USING (site_id, rn)
       JOIN rec_hl y USING (site_id, rn) WHERE rn > 0)""")
def g8(spark, sf):
    bounds = {"temperature": {"mild_upper": 70.0, "mild_lower": 12.0},
              "humidity": {"mild_upper": 80.0, "mild_lower": 20.0}}
    labelled = G.threshold_labels(segmented(spark, sf), KEYS, "ts", bounds, max_gap=GAP,
                                  block_seconds=block(spark, sf, EXIT_REACH))
    return labelled.select("event_id", "target_temperature_high", "target_temperature_low",
                           "target_humidity_high", "target_humidity_low", "target_any")
