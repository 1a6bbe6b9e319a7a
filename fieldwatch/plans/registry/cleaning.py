"""S1-S9, S14, S17 and C1-C12 on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ... import constants as K
from ...operators import cleaning as C
from ...sources import files, layers
from ...session import shared_folder
from .base import KEYS, alarms, cte, query, readings, table


def _raw_text(spark, sf):
    """Readings as the untidy all-text export they arrive as."""
    r = readings(spark, sf)
    bad = F.col("event_id") % 50 == 0
    return r.select(
        "site_id",
        F.when(F.col("event_id") % 101 == 0, "not a date").otherwise(
            F.date_format("ts", "dd/MM/yyyy")).alias(" Date "),
        F.date_format("ts", "HH:mm:ss").alias("TIME"),
        F.when(bad, "n/a").otherwise(F.col("temperature").cast("string")).alias("Temperature"),
        F.col("humidity").cast("string").alias("Humidité"))


def _csv(df):
    """The rows as text files, one header line in each."""
    at = f"{shared_folder(df.sparkSession)}/csv-{uuid.uuid4().hex}"
    df.write.option("header", True).option("encoding", "ISO-8859-1").csv(at)
    return at


@query("s1_read_readings", "readings", """
SELECT site_id, date_trunc('second', ts) AS ts,
       CASE WHEN event_id % 50 <> 0 THEN temperature END AS temperature, humidity, 'room' AS sensor
FROM readings WHERE event_id % 101 <> 0""", "temperature humidity")
def s1(spark, sf):
    scanned = files.scan_text_csv(spark, _csv(_raw_text(spark, sf)))
    return files.parse_readings(scanned, F.col("site_id").cast("bigint"), "room")


@query("s2_read_alarm_log", "alarms", """
SELECT state, log_time, message, send_time FROM alarms""")
def s2(spark, sf):
    raw = alarms(spark, sf).withColumnsRenamed({"log_time": "time", "send_time": "send Time"})
    columns = ["state", "time", "message", "send Time"]
    scanned = files.read_alarm_log(spark, _csv(raw.select(*[F.col(c).cast("string") for c in columns])), columns)
    return scanned.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("log_time", "send_time")})


def _ups(spark, sf):
    described = F.when(F.col("event_id") % 4 == 0, F.concat("message", F.lit(" HAS been Restored"))) \
                 .otherwise(F.col("message"))
    rows = alarms(spark, sf).select(F.date_format("log_time", "dd/MM/yyyy").alias("Date"),
                                    F.date_format("log_time", "HH:mm:ss").alias("Time"), described.alias("Description"))
    return files.read_ups_events(spark, _csv(rows), "SITE UPS ")


cte("ups", "alarms", """
SELECT CASE WHEN event_id % 4 = 0 THEN 'D' ELSE 'A' END AS state,
       date_trunc('second', log_time) AS log_time, 'SITE UPS ' || upper(message) AS message,
       date_trunc('second', log_time) AS send_time FROM alarms""")


@query("s3_read_ups_events", "ups", "SELECT * FROM ups")
def s3(spark, sf):
    return _ups(spark, sf)


@query("s4_filter_site", None, """
SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the ')""")
def s4(spark, sf):
    return files.filter_site(table(spark, sf, "documents"), "THE ", "text").select("doc_id", "source")


@query("s5_union_alarms", "alarms ups", """
SELECT state, log_time, message, send_time FROM alarms
UNION ALL SELECT state, log_time, message, send_time FROM ups""")
def s5(spark, sf):
    return files.union_alarms(alarms(spark, sf), _ups(spark, sf))


@query("s6_load_alarms_clean", "alarms", """
SELECT site_id, state, date_trunc('minute', log_time) AS log_time, message, send_time,
       CASE WHEN contains(upper(message), 'UPS') OR contains(upper(message), 'SOCOMEC')
              OR contains(upper(message), 'BATTERY') THEN 'UPS'
            WHEN contains(upper(message), 'CLIM') OR contains(upper(message), 'STULZ')
              OR contains(upper(message), 'LIEBERT') OR contains(upper(message), 'TEMPERATURE') THEN 'CLIM'
            WHEN contains(upper(message), 'TENSION') OR contains(upper(message), 'ELECTROGENE') THEN 'ENERGY'
            ELSE 'OTHER' END AS category
FROM alarms QUALIFY row_number() OVER (PARTITION BY site_id, date_trunc('minute', log_time), message
                                       ORDER BY send_time, state) = 1""")
def s6(spark, sf):
    coarse = alarms(spark, sf).withColumn(
        "log_time", F.date_trunc("minute", "log_time").cast("timestamp_ntz"))
    return files.load_alarms_clean(coarse, keys=KEYS)


@query("s7_scan_since", "readings", """
SELECT site_id, ts, temperature FROM readings WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'""", "temperature")
def s7(spark, sf):
    return layers.scan_since(readings(spark, sf).select("site_id", "ts", "temperature"), "ts",
                             since="2024-01-15 00:00:00")


@query("s9_ingest_watermark", "readings alarms", """
SELECT 'readings' AS table_name, max(ts) AS last_ts, count(*) AS rows_ingested FROM readings
UNION ALL SELECT 'alarms', max(log_time), count(*) FROM alarms
UNION ALL SELECT 'none', max(ts), count(*) FROM readings WHERE temperature < 0""")
def s9(spark, sf):
    r = readings(spark, sf)
    return layers.ingest_watermark({"readings": (r, "ts"), "alarms": (alarms(spark, sf), "log_time"),
                                    "none": (r.filter("temperature < 0"), "ts")})


@query("s12_align_schema", "readings", """
SELECT CAST(site_id AS VARCHAR) AS site_id, CAST(NULL AS VARCHAR) AS sensor, ts, temperature, humidity,
       CAST(NULL AS BIGINT) AS segment_id, CAST(NULL AS BIGINT) AS segment_position,
       CAST(NULL AS BOOLEAN) AS is_discontinuity, CAST(NULL AS TIMESTAMP) AS segment_start
FROM readings""", "temperature humidity")
def s12(spark, sf):
    return layers.align(readings(spark, sf), "readings")


@query("s14_gold_meta", "readings", """
SELECT site_id, max(ts) AS last_ts,
       greatest(CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0) AS BIGINT), 1) AS span_days,
       0.0::DOUBLE AS shift_days FROM readings GROUP BY site_id""", "shift_days")
def s14(spark, sf):
    return layers.gold_meta(readings(spark, sf), KEYS)


@query("s17_layer_volumes", "readings alarms", """
SELECT 'readings' AS table_name, count(*) AS n_rows, CAST(NULL AS BIGINT) AS segments FROM readings
UNION ALL SELECT 'alarms', count(*), NULL FROM alarms
UNION ALL SELECT 'lineitem', count(*), NULL FROM lineitem""")
def s17(spark, sf):
    return layers.layer_volumes({"readings": readings(spark, sf), "alarms": alarms(spark, sf),
                                 "absent": None, "lineitem": table(spark, sf, "lineitem")})


@query("c1_to_number", None, """
SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE CAST(user_id AS VARCHAR) END AS DOUBLE) AS x
FROM events""", "x")
def c1(spark, sf):
    text = F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.col("user_id").cast("string"))
    return C.to_number(table(spark, sf, "events").select("event_id", text.alias("x")), ["x"])


@query("c2_to_timestamps", None, """
SELECT o_orderkey, o_orderdate AS t FROM orders WHERE o_orderkey % 9 <> 0""")
def c2(spark, sf):
    text = F.when(F.col("o_orderkey") % 9 == 0, "31/31/1999 00:00").otherwise(
        F.date_format("o_orderdate", "dd/MM/yyyy HH:mm"))
    return C.to_timestamps(table(spark, sf, "orders").select("o_orderkey", text.alias("t")),
                           {"t": "dd/MM/yyyy HH:mm"}, required=["t"])


cte("coarse", "readings", """
SELECT event_id, site_id, date_trunc('hour', ts) AS ts, temperature,
       CASE WHEN event_id % 3 <> 0 THEN humidity END AS humidity FROM readings""")


def _coarse(spark, sf):
    return readings(spark, sf).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz")) \
        .withColumn("humidity", F.when(F.col("event_id") % 3 != 0, F.col("humidity")))


@query("c3_dedupe_most_complete", "coarse", """
SELECT * FROM coarse QUALIFY row_number() OVER (PARTITION BY site_id, ts ORDER BY
  (CASE WHEN temperature IS NULL THEN 1 ELSE 0 END + CASE WHEN humidity IS NULL THEN 1 ELSE 0 END),
  event_id) = 1""", "temperature humidity")
def c3(spark, sf):
    return C.dedupe_most_complete(_coarse(spark, sf), KEYS, "ts", ["temperature", "humidity"], ["event_id"])


@query("c4_dedupe_last", "coarse", """
SELECT * FROM coarse QUALIFY row_number() OVER (PARTITION BY site_id, ts ORDER BY event_id DESC) = 1""",
       "temperature humidity")
def c4(spark, sf):
    return C.dedupe_last(_coarse(spark, sf), KEYS, "ts", ["event_id"])


@query("c5_dedupe_first", None, """
SELECT l_orderkey, l_suppkey, l_linenumber, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_quantity) = 1""", "l_quantity")
def c5(spark, sf):
    return C.dedupe_first(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity"),
        ["l_orderkey", "l_suppkey"], ["l_linenumber", "l_quantity"])


@query("c6_null_implausible", "readings", """
SELECT event_id, CASE WHEN temperature BETWEEN 5 AND 60 THEN temperature END AS temperature,
       CASE WHEN humidity BETWEEN 15 AND 100 THEN humidity END AS humidity FROM readings""", "temperature humidity")
def c6(spark, sf):
    return C.null_implausible(readings(spark, sf).select("event_id", "temperature", "humidity"))


_WORDS = {"A": ["ING", "TION"], "B": ["OUA", "EAU"], "C": ["QU"]}


@query("c7_categorise", None, """
SELECT doc_id, CASE WHEN contains(upper(text), 'ING') OR contains(upper(text), 'TION') THEN 'A'
                    WHEN contains(upper(text), 'OUA') OR contains(upper(text), 'EAU') THEN 'B'
                    WHEN contains(upper(text), 'QU') THEN 'C' ELSE 'OTHER' END AS category FROM documents""")
def c7(spark, sf):
    return C.categorise(table(spark, sf, "documents").select("doc_id", "text"), "text", _WORDS).drop("text")


def _flag_sql(words):
    body = "|".join(words)
    return (rf"CASE WHEN regexp_matches(lower(message), '(^|[^0-9a-z_à-ÿ])({body})($|[^0-9a-z_à-ÿ])') "
            "THEN 1 ELSE 0 END")


cte("flagged", "alarms", "SELECT *, " + ", ".join(
    f"{_flag_sql(w)} AS {n}" for n, w in K.FLAG_KEYWORDS.items()) + " FROM alarms")


@query("c8_keyword_flags", "flagged", "SELECT event_id, " + ", ".join(K.FLAG_KEYWORDS) + " FROM flagged")
def c8(spark, sf):
    return C.keyword_flags(alarms(spark, sf).select("event_id", "message"), "message").drop("message")


@query("c9_finite_or_null", None, """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 1 THEN l_quantity / (l_linenumber - 1) END AS ratio
FROM lineitem""", "ratio")
def c9(spark, sf):
    n = F.col("l_linenumber")
    ratio = F.when(n == 1, F.lit(float("inf"))).otherwise(F.try_divide("l_quantity", n - 1))
    return C.finite_or_null(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", ratio.alias("ratio")), ["ratio"])


@query("c10_with_family", None, """
SELECT s_suppkey, coalesce(r_name, 'unknown') AS family FROM supplier
LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
           WHERE n_nationkey % 5 <> 0) d ON s_nationkey = n_nationkey""")
def c10(spark, sf):
    dim = table(spark, sf, "nation").filter("n_nationkey % 5 <> 0").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    units = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return C.with_family(units, dim, "s_nationkey", "n_nationkey", "r_name").drop("s_nationkey")


@query("c12_zero_fill", "coarse", """
SELECT event_id, greatest(coalesce(humidity - 40, 0), 0) AS humidity FROM coarse""", "humidity")
def c12(spark, sf):
    return C.zero_fill(_coarse(spark, sf).select("event_id", (F.col("humidity") - 40).alias("humidity")),
                       ["humidity"])


@query("domain_rejects", "schedule", """
SELECT id, 'period' AS broken FROM schedule WHERE period_value >= 6""")
def rejects(spark, sf):
    from .base import schedule
    _, bad = C.split_rejects(schedule(spark, sf), {"period": F.col("period_value") < 6,
                                                   "unit": F.col("period_unit").isNotNull()})
    return bad.select("id", F.concat_ws(",", "broken_rules").alias("broken"))
