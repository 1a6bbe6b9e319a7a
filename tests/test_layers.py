"""Sources, layer writes, refresh, export and import."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldwatch.plans.refresh import Config, refresh
from fieldwatch.sources import files, layers
from test_scoring_forecast import site


def test_sensor_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes(
        " Date ,time, Temperature,Humidité \n01/02/2026,00:02:00,24.5,46\nbad,00:04:00,1,2\n02/02/2026,10:00:00,x,45.5\n".encode("latin-1"))
    rows = files.read_readings(spark, str(tmp_path / "r.csv"), "a", "room").orderBy("ts").collect()
    assert [(str(r["ts"]), r["temperature"], r["humidity"], r["sensor"]) for r in rows] == [
        ("2026-02-01 00:02:00", 24.5, 46.0, "room"), ("2026-02-02 10:00:00", None, 45.5, "room")]


def test_alarm_log_and_ups_list(spark, tmp_path):
    (tmp_path / "a.csv").write_text("junk,,,\nstate,time,message,send Time\nA,2026-01-01 00:00:00,TENSION,2026-01-01 00:00:01\n")
    log = files.read_alarm_log(spark, str(tmp_path / "a.csv"), ["state", "time", "message", "send Time"]).collect()
    assert [(r["state"], r["log_time"]) for r in log] == [("A", "2026-01-01 00:00:00")]
    (tmp_path / "u.csv").write_text("export of today,,\nDate,Time,Description\n01/02/2026,03:04:05,Battery low\n01/02/2026,03:05:00,Battery low HAS been restored\n")
    ups = files.read_ups_events(spark, str(tmp_path / "u.csv"), "X ").orderBy("log_time").collect()
    assert [(r["state"], r["message"]) for r in ups] == [("A", "X BATTERY LOW"), ("D", "X BATTERY LOW")]


def test_alarm_duplicates(spark):
    rows = [("a", "A", f"2026-01-01 00:{i:02d}:00", "UPS ALARM", None) for i in range(50)]
    df = spark.createDataFrame(rows + rows[:10], "site_id string, state string, log_time string, message string, send_time string")
    out = files.load_alarms_clean(df, keys=["site_id"])
    assert out.count() == 50 and {r["category"] for r in out.select("category").distinct().collect()} == {"UPS"}


def test_refresh_export_import(spark, tmp_path):
    readings, alarms = site(spark, 300)
    readings = readings.withColumn("sensor", F.lit("room"))
    alarms = alarms.withColumn("send_time", F.col("log_time"))
    root = str(tmp_path / "lake")
    cfg = Config(root, sources=lambda s: (readings, alarms), ingested_at="2026-02-01 00:00:00")
    first = {r["table_name"]: r["n_rows"] for r in refresh(spark, cfg).collect()}
    assert first["raw_readings"] == 9000 and first["readings"] == 9000 and first["hourly"] == 300
    assert first["forecast_points"] == (24 + 24) + (28 + 28) + (13 + 30) and first["snapshot"] == 4 and first["gold_meta"] == 1
    again = {r["table_name"]: r["n_rows"] for r in refresh(spark, cfg).collect()}
    assert again == first  # loading twice changes nothing
    mark = layers.ingest_watermark({"r": (layers.read_layer(spark, root, "raw_readings"), "ts")}).first()
    assert str(mark["last_ts"]) == "2026-01-13 11:58:00"

    out = str(tmp_path / "gold")
    layers.export_gold(spark, root, out, shift_to="2026-05-10 10:30:00")
    end = layers.read_gold(spark, out, "hourly").agg(F.max("timestamp")).first()[0]
    assert str(end) == "2026-05-10 10:00:00"
    meta = layers.read_layer(spark, out, "gold_meta").first()
    assert meta["last_ts"] <= pd.Timestamp("2026-05-10 10:30:00") and meta["shift_days"] > 100
    moved = layers.read_gold(spark, out, "forecast_points", horizon="24h")
    assert moved.filter("is_forecast").agg(F.min("timestamp")).first()[0] > end
    assert layers.read_gold(spark, out, "hourly", since="2026-05-10 00:00:00").count() == 11
    assert moved.filter("lower > value OR value > upper").count() == 0

    target = str(tmp_path / "served")
    layers.import_gold(spark, out, target)
    with pytest.raises(RuntimeError):
        layers.import_gold(spark, out, target)
    layers.import_gold(spark, out, target, replace_existing=True)
    with pytest.raises(ValueError):
        layers.import_gold(spark, str(tmp_path / "nothing"), target)


def test_refresh_with_stored_models(spark, tmp_path):
    """The stored state model replaces the threshold detector; the stored forest adds alarm outliers."""
    import numpy as np

    from fieldwatch.models import hmm, iforest, store
    readings, alarms = site(spark, 120)
    readings = readings.withColumn("sensor", F.lit("room")).withColumn(
        "temperature", F.when(F.minute("ts") < 20, F.col("temperature") + 30).otherwise(F.col("temperature")))
    alarms = alarms.withColumn("send_time", F.col("log_time"))
    params = hmm.Params(np.array([0.5, 0.5]), np.full((2, 2), 0.5), np.array([[24.5, 46.0], [54.5, 46.0]]), np.full((2, 2), 4.0))
    model = hmm.HmmModel(params, hmm.Scaler([0.0, 0.0], [1.0, 1.0]), ["temperature", "humidity"], 0.0, True, [1],
                         {"mild_lower": 0.0, "mild_upper": 40.0, "extreme_lower": -10.0, "extreme_upper": 60.0})
    forest = iforest.Forest(["total_alarms"], hmm.Scaler([0.0], [1.0]), [tuple(map(np.array, ([-1], [0.0], [-1], [-1], [1.0])))], 8, 0.0)
    store.save_state_model(spark, model, str(tmp_path / "state"))
    store.save_forest(spark, forest, str(tmp_path / "forest"))
    back = store.load_state_model(spark, str(tmp_path / "state"))
    assert back.thresholds == model.thresholds and np.array_equal(back.params.mean, params.mean)
    with pytest.raises(ValueError):
        store.load_forest(spark, str(tmp_path / "state"))
    root = str(tmp_path / "lake")
    skip = lambda *_: None
    refresh(spark, Config(root, sources=lambda s: (readings, alarms), ingested_at="2026-02-01 00:00:00", state_model_path=str(tmp_path / "state"),
                          forest_path=str(tmp_path / "forest"), stages={"score": skip, "forecast": skip}))
    eps = layers.read_layer(spark, root, "episodes")
    found = {r["dimension"]: r["n"] for r in eps.groupBy("dimension").agg(F.count("*").alias("n")).collect()}
    assert found["environment"] == 120 and found["scada"] > 0 and eps.select("site_id", "id").distinct().count() == eps.count()
    assert {r["equipment"] for r in eps.filter("dimension = 'scada'").collect()} <= {"UPS", "CLIM", "ENERGY", "OTHER"}
