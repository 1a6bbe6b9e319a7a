"""Tables written to the shared folder and read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...models import iforest, store
from ...operators import forecasting as FC
from ...sources import layers as L
from ...session import shared_folder
from ..refresh import Config, refresh
from .alarms_scoring import events
from .base import BLOCK, GAP, alarms, cte, query, readings
from .models import FIXED, FIXED_FOREST, FOREST_SQL, PREDICTED, _decoded, _fixed_sequences, served_model
from .episodes import _CHARACTER as CHARACTER
from .segments import hysteresis_sql, segmented


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _site(df):
    return df.withColumns({"site_id": F.col("site_id").cast("string"), "sensor": F.lit("room")})


@query("s8_write_bronze", "readings", """
SELECT CAST(site_id AS VARCHAR) AS site_id, ts, temperature, humidity, 'room' AS sensor, TIMESTAMP '2024-02-01' AS ingested_at, 'b1' AS batch_id
FROM readings""", "temperature humidity")
def s8(spark, sf):
    root, at = _folder(spark, "bronze"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    for _ in range(2):  # loading twice leaves the same rows
        L.write_bronze(_site(readings(spark, sf)), root, "raw_readings", "b1", at)
    return L.read_layer(spark, root, "raw_readings")


@query("s10_s11_silver_round_trip", "seg", """
SELECT CAST(site_id AS VARCHAR) AS site_id, 'room' AS sensor, ts, temperature, humidity, segment_id, segment_position, is_discontinuity, segment_start
FROM seg""", "temperature humidity")
def s10(spark, sf):
    root = _folder(spark, "silver")
    L.write_silver(segmented(spark, sf), root, "readings", sensor="room")
    return L.read_layer(spark, root, "readings")


def lake(spark, sf):
    """A freshly refreshed lake: (root, volumes)."""
    root = _folder(spark, "lake")
    log = alarms(spark, sf).withColumn("site_id", F.col("site_id").cast("string"))
    cfg = Config(root, GAP, BLOCK, sources=lambda s: (_site(readings(s, sf)), log), ingested_at="2024-02-01 00:00:00")
    return root, refresh(spark, cfg)


# the lake keeps every temperature, so its episodes are found anew
cte("seg_lake", "seg tukey_t", "SELECT s.*, mild_upper, mild_lower, extreme_upper, extreme_lower FROM seg s JOIN tukey_t USING (site_id)")
hysteresis_sql("lake", "seg_lake", "temperature", "mild_upper", "mild_upper - 0.5")
cte("lake_inside", "rec_lake seg_lake", """
SELECT s.*, h.episode_id FROM seg_lake s JOIN rec_lake h ON h.rn > 0 AND h.event_id = s.event_id WHERE h.episode_id > 0""")
cte("lake_episodes", "lake_inside", CHARACTER.format(keys="site_id, episode_id", src="lake_inside"))

_VOLUMES = """
SELECT 'raw_readings' AS table_name, count(*) AS n_rows FROM readings UNION ALL SELECT 'raw_alarms', count(*) FROM alarms
UNION ALL SELECT 'readings', count(*) FROM readings UNION ALL SELECT 'alarms', count(*) FROM alarms
UNION ALL SELECT 'hourly', count(*) FROM scored UNION ALL SELECT 'snapshot', 4 * count(*) FROM last_hour
UNION ALL SELECT 'forecast_points', count(*) FROM points UNION ALL SELECT 'gold_meta', count(*) FROM last_hour
UNION ALL SELECT 'episodes', count(*) FROM lake_episodes"""


@query("s19_refresh", "readings alarms scored last_hour points lake_episodes", _VOLUMES)
def s19(spark, sf):
    return lake(spark, sf)[1].select("table_name", "n_rows")


cte("shift", "scored", """
SELECT CAST(site_id AS VARCHAR) AS site, TIMESTAMP '2026-05-10 10:00:00' - max(timestamp) AS d,
       (epoch(TIMESTAMP '2026-05-10 10:00:00') - epoch(max(timestamp))) / 86400 AS days FROM scored GROUP BY site_id""")


# every exported table: what names a row, its shifted time, and a measure
@query("s15_export_gold", "shift scored snapshot points lake_episodes readings", """
SELECT 'hourly' AS table_name, site AS site_id, '' AS item, timestamp + d AS timestamp, overall_site_health AS value FROM scored JOIN shift ON site = CAST(site_id AS VARCHAR)
UNION ALL SELECT 'snapshot', site, coalesce(family, 'global') || ' ' || status || ' ' || trend, timestamp + d, score FROM snapshot JOIN shift ON site = CAST(site_id AS VARCHAR)
UNION ALL SELECT 'forecast_points', site, horizon || ' ' || CASE WHEN is_forecast THEN 'ahead' ELSE 'past' END, timestamp + d, value FROM points JOIN shift ON site = CAST(site_id AS VARCHAR)
UNION ALL SELECT 'episodes', site, direction || ' ' || severity, start + d, round_even(peak_value * 100, 0) / 100 FROM lake_episodes JOIN shift ON site = CAST(site_id AS VARCHAR)
UNION ALL SELECT 'gold_meta', site, '', least(max(ts) + any_value(d), TIMESTAMP '2026-05-10 10:20:00'), round(any_value(days), 3) FROM readings JOIN shift ON site = CAST(site_id AS VARCHAR) GROUP BY site""", "value")
def s15(spark, sf):
    out = _folder(spark, "export")
    L.export_gold(spark, lake(spark, sf)[0], out, shift_to="2026-05-10 10:20:00")
    shown = {"hourly": ("''", "timestamp", "overall_site_health"), "snapshot": ("concat_ws(' ', coalesce(family, 'global'), status, trend)", "timestamp", "score"),
             "forecast_points": ("concat_ws(' ', horizon, if(is_forecast, 'ahead', 'past'))", "timestamp", "value"),
             "episodes": ("concat_ws(' ', direction, severity)", "start", "peak_value"), "gold_meta": ("''", "last_ts", "shift_days")}
    tables = [L.read_gold(spark, out, name).selectExpr(f"'{name}' AS table_name", "site_id", f"{item} AS item", f"{at} AS timestamp", f"{value} AS value")
              for name, (item, at, value) in shown.items()]
    return reduce(DataFrame.unionByName, tables)


@query("s16_import_gold", "scored last_hour points lake_episodes", """
SELECT 'hourly' AS table_name, count(*) AS n_rows FROM scored UNION ALL SELECT 'snapshot', 4 * count(*) FROM last_hour
UNION ALL SELECT 'forecast_points', count(*) FROM points UNION ALL SELECT 'gold_meta', count(*) FROM last_hour
UNION ALL SELECT 'episodes', count(*) FROM lake_episodes""")
def s16(spark, sf):
    out = _folder(spark, "export")
    L.export_gold(spark, lake(spark, sf)[0], out)
    done = L.import_gold(spark, out, _folder(spark, "served"))
    return done.select("table_name", "n_rows")


@query("s18_model_round_trip", "newest", PREDICTED, "predicted_delta predicted_health")
def s18(spark, sf):
    hourly, model = served_model(spark, sf)
    at = _folder(spark, "model")
    FC.save_model(model, at)
    return FC.predict_next(hourly, FC.load_model(spark, at))


@query("s18_state_model_round_trip", "decoded", "SELECT site_id, event_id, CAST(state AS INTEGER) AS state FROM decoded")
def s18_state(spark, sf):
    at = _folder(spark, "state-model")
    store.save_state_model(spark, FIXED, at)
    return _decoded(_fixed_sequences(spark, sf), store.load_state_model(spark, at)).select("site_id", "event_id", "state")


@query("s18_forest_round_trip", "event_features", FOREST_SQL, "score")
def s18_forest(spark, sf):
    at = _folder(spark, "forest")
    store.save_forest(spark, FIXED_FOREST, at)
    return iforest.score_isolation(events(spark, sf), store.load_forest(spark, at)).select("site_id", "alarm_event", "is_anomaly", "score")
