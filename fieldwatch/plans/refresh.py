"""The batch refresh: bronze -> silver -> episodes -> hourly scores -> forecast."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..models import hmm, iforest, store
from ..operators import aggregates as A
from ..operators import cleaning as C
from ..operators import episodes as E
from ..operators import forecasting as FC
from ..operators import hourgrid as H
from ..operators import quantiles as Q
from ..operators import scoring as S
from ..operators import segments as G
from ..operators import windows as W
from ..session import durable_checkpoint, prepare
from ..sources import layers as L

SERIES, SITE = ["site_id", "sensor"], ["site_id"]


@dataclass
class Config:
    root: str
    max_gap: float = K.READING_GAP_SECONDS
    block_seconds: float = 86_400.0
    residual_std: float = 10.0
    model_path: str | None = None
    state_model_path: str | None = None   # stored state model; without one the threshold detector runs
    forest_path: str | None = None        # stored forest; adds alarm outliers to the episodes
    sources: Callable[[SparkSession], tuple[DataFrame, DataFrame]] | None = None
    batch_id: str = "batch"
    ingested_at: str | None = None   # required by the ingest stage
    rounds: int = 2000
    counts: tuple[int, ...] = tuple(K.FEATURE_COUNTS)
    forecast_sources: tuple[str, ...] = tuple(K.TRAJECTORY_SOURCES)
    stages: dict[str, Callable] = field(default_factory=dict)  # replaces a stage by name


def ingest(spark: SparkSession, cfg: Config) -> None:
    if cfg.ingested_at is None:
        raise ValueError("say when this batch was ingested (Config.ingested_at)")
    readings, alarms = cfg.sources(spark)
    at = F.lit(cfg.ingested_at).cast("timestamp_ntz")
    L.write_bronze(readings, cfg.root, "raw_readings", cfg.batch_id, at)
    L.write_bronze(alarms, cfg.root, "raw_alarms", cfg.batch_id, at)


def transform(spark: SparkSession, cfg: Config) -> None:
    raw = L.read_layer(spark, cfg.root, "raw_readings")
    clean = C.dedupe_most_complete(raw, SERIES, "ts", ["temperature", "humidity"], ["batch_id"])
    L.write_silver(G.add_segments(clean, SERIES, "ts", cfg.max_gap, cfg.block_seconds), cfg.root, "readings")
    alarms = L.read_layer(spark, cfg.root, "raw_alarms").na.drop(subset=["log_time", "message"])
    first = C.dedupe_first(alarms, ["site_id", "log_time", "message"], ["send_time", "state"])
    L.write_silver(C.categorise(first, "message"), cfg.root, "alarms")


def detect(spark: SparkSession, cfg: Config) -> None:
    readings = L.read_layer(spark, cfg.root, "readings")
    as_of = H.observation_bounds(readings, SERIES, "ts")
    if cfg.state_model_path:
        eps = detect_states(spark, cfg, readings, as_of)
    else:
        eps = E.threshold_episodes(
            readings, SERIES, "ts", "temperature", Q.tukey(readings, SERIES, "temperature"), as_of, F.col("sensor"),
            max_gap=cfg.max_gap, block_seconds=cfg.block_seconds)
    if cfg.forest_path:
        eps = eps.unionByName(detect_alarm_outliers(spark, cfg))
    # ids are unique within a site, whatever number of sensors it has
    L.write_gold(E.number_episodes(eps.drop("id"), SITE, ties=["sensor"]), cfg.root, "episodes")


def detect_states(spark: SparkSession, cfg: Config, readings: DataFrame, as_of: DataFrame) -> DataFrame:
    """Anomalous state runs that cross the stored training thresholds."""
    model = store.load_state_model(spark, cfg.state_model_path)
    if not model.thresholds:
        raise ValueError("the stored state model carries no training thresholds")
    rows = W.state_features(readings, SERIES, "ts", max_gap=cfg.max_gap, block_seconds=cfg.block_seconds)
    seqs = durable_checkpoint(G.add_sequences(rows, SERIES, "ts", model.cols, cfg.max_gap, block_seconds=cfg.block_seconds))
    return E.state_episodes(hmm.decode_rows(seqs, SERIES, model), SERIES, "ts", "temperature", model.thresholds, as_of,
                            F.col("sensor"), block_seconds=cfg.block_seconds)


def detect_alarm_outliers(spark: SparkSession, cfg: Config) -> DataFrame:
    """Alarm events that the stored forest calls outliers, named by their dominant category."""
    keys = [*SITE, "alarm_event"]
    alarms = L.read_layer(spark, cfg.root, "alarms")
    numbered = durable_checkpoint(G.add_events(alarms, SITE, "log_time", block_seconds=cfg.block_seconds, ties=["message"])
                                  .withColumnRenamed("event_id", "alarm_event"))
    events = A.event_features(numbered, keys, "log_time", "message", "state").join(
        A.dominant(numbered, keys, "category"), keys)
    scored = iforest.score_isolation(events, store.load_forest(spark, cfg.forest_path))
    found = iforest.outlier_episodes(scored, [*SITE, "dominant_category"]).withColumnRenamed("dominant_category", "sensor")
    as_of = alarms.groupBy(*SITE).agg(F.max("log_time").alias("last_ts"))
    as_of = found.select(*SERIES).distinct().join(as_of, SITE)
    return E.finish_episodes(found, SERIES, as_of, F.col("sensor"), dimension="scada")


def score(spark: SparkSession, cfg: Config) -> None:
    hourly = S.health_scores(L.read_layer(spark, cfg.root, "readings"), L.read_layer(spark, cfg.root, "alarms"), SITE,
                             reading_order=["sensor"], strict=False)
    L.write_gold(hourly, cfg.root, "hourly")
    stored = spark.read.parquet(f"{cfg.root}/hourly").select(*L.SCHEMAS["hourly"])
    trends = W.trend_volatility(stored.drop("overall_site_health_trend_24h", "overall_site_health_volatility_24h"), SITE,
                              H.HOUR, ["overall_site_health", *K.SUBSYSTEM_HEALTH])
    L.write_gold(S.snapshot(trends, SITE), cfg.root, "snapshot")
    L.write_gold(L.gold_meta(L.read_layer(spark, cfg.root, "readings"), SITE), cfg.root, "gold_meta")


def forecast(spark: SparkSession, cfg: Config, train: bool) -> None:
    hourly = L.read_layer(spark, cfg.root, "hourly")
    hourly = hourly.withColumn("overall_site_health_smoothed_6h", F.col("overall_site_health_smoothed")).withColumn(
        "energy_risk_score_calibrated", F.col("energy_risk_score"))
    longest = max(h for h, _, _ in K.HORIZONS.values())
    if train:
        frame, names = FC.model_frame(hourly, SITE, cfg.forecast_sources)
        model = FC.fit_delta(frame, names, SITE, cfg.counts, cfg.rounds)
        model.drop_model, model.drop_threshold, model.metrics["drop"] = FC.fit_drop(frame, model)
        FC.save_model(model, cfg.model_path or f"{cfg.root}/model")
    elif cfg.model_path:
        model = FC.load_model(spark, cfg.model_path)
    else:
        model = None
    path = FC.forecast_recursive(hourly, model, longest) if model else \
        FC.persistence_trajectory(hourly, SITE, longest, cfg.residual_std)
    slim = hourly.select(*SITE, H.HOUR, "overall_site_health")
    L.write_gold(FC.forecast_points(slim, path, SITE), cfg.root, "forecast_points")


def refresh(spark: SparkSession, cfg: Config, skip_ingest: bool = False, train: bool = False) -> DataFrame:
    """Run every stage (each one replaceable through ``cfg.stages``); returns layer volumes.

    A stage reads what the previous one wrote, so a failed run resumes from its last table.
    """
    prepare(spark)
    use = lambda name, default: cfg.stages.get(name, default)
    if not skip_ingest:
        use("ingest", ingest)(spark, cfg)
    use("transform", transform)(spark, cfg)
    use("detect", detect)(spark, cfg)
    use("score", score)(spark, cfg)
    stage = cfg.stages.get("forecast")
    stage(spark, cfg) if stage else forecast(spark, cfg, train)
    present = {n: L.read_layer(spark, cfg.root, n) for n in L.SCHEMAS if not L.missing_tables(spark, cfg.root, [n])}
    return L.layer_volumes(present)
