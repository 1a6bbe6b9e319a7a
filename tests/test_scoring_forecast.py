"""Scoring and forecast behaviour on small synthetic sites."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldwatch import constants as K
from fieldwatch.operators import forecasting as FC
from fieldwatch.operators import scoring as S
from fieldwatch.operators import windows as W
from fieldwatch.session import durable_checkpoint

KEY = ["site_id"]


def site(spark, hours, dropouts=False, shift_days=0):
    rng = np.random.default_rng(5)
    n = hours * 30
    ts = pd.date_range("2026-01-01", periods=n, freq="2min")
    hum = 46 + rng.normal(0, 0.3, n)
    if dropouts:
        hum[::500] = 0.0
    readings = spark.createDataFrame(pd.DataFrame({"site_id": "a", "ts": ts, "temperature": 24.5 + rng.normal(0, 0.1, n), "humidity": hum}))
    at = pd.date_range("2026-01-01", periods=hours, freq="1h") + pd.Timedelta(days=shift_days)
    text = ["UPS UNIT 1 GENERAL ALARM" if i % 5 == 0 else "ABSENCE DE TENSION" if i % 17 == 0 else "RECTIFIER FAULT" for i in range(hours)]
    log = spark.createDataFrame(pd.DataFrame({"site_id": "a", "log_time": at, "state": "A", "message": text}))
    ntz = lambda d, c: d.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return ntz(readings, "ts"), ntz(log, "log_time")


@pytest.fixture(scope="module")
def hourly(spark):
    return durable_checkpoint(S.health_scores(*site(spark, 400), KEY))


def test_scores_are_bounded_and_complete(hourly):
    pdf = hourly.toPandas()
    assert len(pdf) == 400 and pdf["timestamp"].nunique() == 400
    for c in ("overall_site_health", "environmental_health_score", "energy_health_score", "battery_health_score"):
        assert pdf[c].between(0, 100).all()
    assert set(pdf["weight_version"]) == {"v1.0"}


def test_no_overlap_is_refused(spark):
    with pytest.raises(ValueError):
        S.health_scores(*site(spark, 48, shift_days=365), KEY, strict=True)


def test_dropout_is_not_a_reading(spark):
    mean = lambda d: S.health_scores(*site(spark, 240, dropouts=d), KEY).agg(F.avg("environmental_health_score")).first()[0]
    assert abs(mean(True) - mean(False)) < 1.0


def test_features_do_not_look_ahead(hourly):
    cut = hourly.orderBy("timestamp").limit(370)
    wanted = ["overall_site_health_slope_6h", "overall_health_lag_24h", "energy_risk_score_rollstd_12h",
              "overall_health_consecutive_decline_hours"]
    last = lambda d: FC.model_frame(d, KEY, ["overall_site_health", "energy_risk_score"])[0].select("timestamp", *wanted)
    short = last(cut).orderBy(F.col("timestamp").desc()).first()
    full = last(hourly).filter(F.col("timestamp") == F.lit(short["timestamp"])).first()
    assert list(short[1:]) == pytest.approx(list(full[1:]), abs=1e-9)


def test_short_history_is_refused(hourly):
    frame, names = FC.model_frame(hourly.orderBy("timestamp").limit(200), KEY, ["overall_site_health"])
    with pytest.raises(ValueError):
        FC.fit_delta(frame, names, KEY, counts=(5,), rounds=2)


def test_train_predict_unroll_and_storage(spark, hourly, tmp_path):
    sources = ["overall_site_health"]
    frame, names = FC.model_frame(hourly, KEY, sources)
    model = FC.fit_delta(frame, names, KEY, counts=(5, 10), rounds=12, rate=0.1)
    assert min(model.metrics["trees_by_count"].values()) >= 1 and set(model.metrics["rounds_by_count"].values()) == {12}
    by = model.metrics["validation_mae_by_count"]
    assert by[len(model.features)] == min(by.values()) and model.residual_std > 0
    assert sum(model.n_rows.values()) >= 200
    one = FC.predict_next(hourly, model).first()
    path = FC.forecast_recursive(hourly, model, 720).orderBy("timestamp").collect()
    assert len(path) == 120
    assert path[0]["value"] == pytest.approx(one["predicted_health"], abs=1e-6)  # arrays = Spark model
    width = [r["upper"] - r["lower"] for r in path if 0 < r["lower"] and r["upper"] < 100]
    assert width == sorted(width)
    start = hourly.orderBy(F.col("timestamp").desc()).first()["overall_site_health"]
    first = abs(path[0]["value"] - start)
    assert FC.K.DAMPING == 0.5 and abs(path[3]["value"] - start) <= 4 * max(first, 25)
    FC.save_model(model, str(tmp_path / "m"))
    again = FC.load_model(spark, str(tmp_path / "m"))
    assert again.features == model.features
    assert FC.predict_next(hourly, again).first()["predicted_health"] == pytest.approx(one["predicted_health"])


def test_the_fit_of_the_query_is_not_cut(spark, monkeypatch):
    """m7 hands over every source and keeps the operator's rounds, patience and counts."""
    import inspect
    from fieldwatch.plans.registry import models as registered
    seen = {}
    real, frame = inspect.signature(FC.fit_delta), inspect.signature(FC.model_frame)

    def caught(call, signature):
        def run(*args, **options):
            bound = signature.bind(*args, **options)
            bound.apply_defaults()
            seen[call] = bound.arguments
            if call == "fit":
                raise StopIteration
            return None, ["x"]
        return run
    monkeypatch.setattr(registered, "frame_hourly", lambda spark, sf: None)
    monkeypatch.setattr(FC, "model_frame", caught("frame", frame))
    monkeypatch.setattr(FC, "fit_delta", caught("fit", real))
    with pytest.raises(StopIteration):
        registered.m7(spark, "")
    assert list(seen["frame"]["sources"]) == FC.K.TRAJECTORY_SOURCES
    assert (seen["fit"]["rounds"], seen["fit"]["patience"], seen["fit"]["rate"], tuple(seen["fit"]["counts"])) == (2000, 100, 0.02, (20, 50, 100, 200))


def test_medians_fill_what_is_null_or_not_finite(spark):
    from fieldwatch.operators import aggregates as A
    kinds = "site_id int, n int, a double, `b c` double, d int"
    rows = [(1, 0, 1.0, None, 4), (1, 1, float("inf"), None, None), (1, 2, 4.0, float("nan"), 7), (2, 3, None, 2.0, None), (None, 4, None, 5.0, 1)]
    df, cols = spark.createDataFrame(rows, kinds), ["a", "b c", "d"]
    medians = A.feature_medians(df, ["site_id"], cols)
    assert sorted(map(tuple, medians.collect()), key=str) == [(1, 2.5, None, 5.5), (2, None, 2.0, None), (None, None, None, None)]
    assert FC.drop_all_null(df.filter("site_id = 1"), cols) == ["a", "d"]
    filled = [tuple(r) for r in A.impute_median(df, medians, ["site_id"], cols).select("n", *cols).orderBy("n").collect()]
    assert filled == [(0, 1.0, None, 4.0), (1, 2.5, None, 5.5), (2, 4.0, None, 7.0), (3, None, 2.0, None), (4, None, 5.0, 1.0)]
    ready = FC._ready(df, medians, ["site_id"], cols).orderBy("n").collect()
    assert [list(r["_x"]) for r in ready[1:4]] == [[2.5, 0.0, 5.5], [4.0, 0.0, 7.0], [0.0, 2.0, 0.0]] and ready[3]["a"] == 0.0


def _drop_frame(spark, drops):
    """100 hours of one site; hours in ``drops`` precede a major drop."""
    from fieldwatch import constants as K
    rows = spark.range(100).select(F.lit(1).alias("site_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id)").alias("timestamp"),
                                   F.col("id").isin(*drops).cast("int").alias("major_drop_6h"), (F.col("id") % 7).cast("double").alias("x"))
    return rows.withColumns({c: F.lit(1.0) for c in K.REQUIRED_FEATURES if c not in rows.columns})


def test_drop_classifier_on_a_history_of_one_class(spark):
    """Drops after the training hours only: no forest, but a threshold of the candidates and the test's own counts."""
    from fieldwatch import constants as K
    from fieldwatch.operators import forecasting as FC
    medians = spark.createDataFrame([(1, 3.0)], "site_id int, x double")
    model = FC.DeltaModel(FC.boosting.Boosted(0.0, [], [0.0]), ["x"], medians, ["site_id"], 1.0)
    fitted, threshold, report = FC.fit_drop(_drop_frame(spark, [80, 90, 95]), model, trees=3)
    assert fitted is None and threshold == min(K.DROP_THRESHOLDS) and report["status"].startswith("not trained")
    assert (report["actual_events"], report["predicted_alerts"], report["f1"]) == (2, 0, 0.0)
    fitted, threshold, report = FC.fit_drop(_drop_frame(spark, [3, 20, 33, 41, 50, 66]), model, trees=3)
    assert fitted is not None and threshold in K.DROP_THRESHOLDS and report["actual_events"] == 0


def test_features_of_a_long_history_are_taken_block_by_block(spark):
    """1,100 hours lie in two blocks; each feature, target and streak is that of the whole series."""
    n, rng = 1100, np.random.default_rng(3)
    cols = list(dict.fromkeys([*K.CURRENT_FEATURES, *K.TRAJECTORY_SOURCES]))
    names = ["overall_health_lag_168h", "health_mean_168h", "health_min_168h", "overall_site_health_rollstd_24h", "overall_site_health_slope_24h",
             "overall_site_health_accel_6h", "target_health_6h"]
    pdf = pd.DataFrame({c: rng.uniform(20, 90, n) for c in cols} | {"site_id": "a", "timestamp": pd.date_range("2026-01-01", periods=n, freq="1h")})
    pdf.loc[900:, "overall_site_health"] = np.linspace(90, 30, 200)   # a fall across the border
    pdf.loc[1030, "overall_site_health"] = np.nan
    hourly = spark.createDataFrame(pdf).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    frame, _ = FC.model_frame(hourly, KEY, ["overall_site_health"])
    assert "_block" in frame._jdf.queryExecution().optimizedPlan().toString()   # no task has the wide rows of a whole site
    got = frame.select("timestamp", FC.GLOBAL_STREAK, *names).orderBy("timestamp").toPandas()
    plain = hourly.withColumn("_i", F.row_number().over(Window.partitionBy(*KEY).orderBy("timestamp")))
    plain = W.targets(plain, KEY, "timestamp").withColumns(W.base_columns(KEY, "timestamp") | W.trajectory_columns(KEY, "timestamp", "overall_site_health"))
    want = plain.select("timestamp", *names).orderBy("timestamp").toPandas()
    pd.testing.assert_frame_equal(got.drop(columns=FC.GLOBAL_STREAK), want)
    health, streak, so_far = pdf["overall_site_health"].to_numpy(), [], 0
    for i in range(n):
        so_far = so_far + 1 if i and health[i] < health[i - 1] else 0
        streak.append(so_far)
    assert got[FC.GLOBAL_STREAK].tolist() == streak and max(streak) > 100
