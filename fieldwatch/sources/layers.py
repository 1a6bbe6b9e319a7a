"""Bronze / silver / gold tables: typed reads, aligned writes, watermarks, export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import epoch_us
from ..operators.episodes import anchor_delta, refresh_status, shift_time
from ..operators.hourgrid import observation_bounds

_S, _D, _N, _L, _B = "string", "double", "timestamp_ntz", "bigint", "boolean"

SCHEMAS: dict[str, dict[str, str]] = {
    "raw_readings": {"site_id": _S, "ts": _N, "temperature": _D, "humidity": _D, "sensor": _S,
                     "ingested_at": _N, "batch_id": _S},
    "raw_alarms": {"site_id": _S, "log_time": _N, "send_time": _N, "state": _S, "message": _S,
                   "ingested_at": _N, "batch_id": _S},
    "readings": {"site_id": _S, "sensor": _S, "ts": _N, "temperature": _D, "humidity": _D,
                 "segment_id": _L, "segment_position": _L, "is_discontinuity": _B,
                 "segment_start": _N},
    "alarms": {"site_id": _S, "log_time": _N, "send_time": _N, "state": _S, "message": _S,
               "category": _S},
    "episodes": {"id": _S, "site_id": _S, "equipment": _S, "type": _S, "severity": _S,
                 "direction": _S, "start": _N, "duration_min": _D, "peak_value": _D,
                 "status": _S, "dimension": _S},
    "hourly": {
        "site_id": _S, "timestamp": _N,
        **{c: _D for c in (
            "environmental_health_score", "energy_health_score", "battery_health_score",
            "overall_site_health", "overall_site_health_smoothed", "environmental_risk_score",
            "energy_risk_score", "battery_risk_score", "environmental_base_risk",
            "energy_base_risk", "battery_base_risk", "environmental_pm_risk", "energy_pm_risk",
            "battery_pm_risk", "environmental_anomaly_burden", "energy_anomaly_burden",
            "battery_anomaly_burden", "overall_site_health_trend_24h",
            "overall_site_health_volatility_24h")},
        "main_risk_driver": _S, "main_driver_share": _D, "site_health_status": _S,
        "health_trend_status": _S, "maintenance_priority": _S, "recommended_action": _S,
        "temperature": _D, "humidity": _D, "outage_duration_hours": _D,
        "battery_alarm_duration_hours": _D, "observation_count": _L, "score_confidence": _D,
        "weight_version": _S, "score_version": _S},
    "snapshot": {"site_id": _S, "timestamp": _N, "scope": _S, "family": _S, "score": _D,
                 "status": _S, "trend": _S},
    "forecast_points": {"site_id": _S, "horizon": _S, "timestamp": _N, "value": _D, "lower": _D,
                        "upper": _D, "is_forecast": _B},
    "gold_meta": {"site_id": _S, "last_ts": _N, "span_days": _L, "shift_days": _D},
}
REQUIRED = {"readings": ["site_id", "ts"], "alarms": ["site_id", "log_time", "message"]}
PARTITIONS = {"raw_readings": "ts", "raw_alarms": "log_time", "readings": "ts",
              "alarms": "log_time", "hourly": "timestamp"}
GOLD = ["episodes", "hourly", "snapshot", "forecast_points", "gold_meta"]
GOLD_TIMES = {"episodes": ["start"], "hourly": ["timestamp"], "snapshot": ["timestamp"],
              "forecast_points": ["timestamp"]}


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in SCHEMAS[name].items()))


def align(df: DataFrame, name: str) -> DataFrame:
    """Exactly the table's columns: missing ones become NULL, extra ones are dropped."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c)
                       for c, t in SCHEMAS[name].items()])


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    """Aligned Parquet table, by date where the table is a time series.

    Series are clustered by (site, day) before the write, which yields few large files per
    partition, and within them the statistics needed to skip row groups.  A whole-table
    overwrite is staged by Spark's committer, so a lost executor leaves the job retryable.
    """
    rows = align(df, name)
    if name in REQUIRED:
        rows = rows.na.drop(subset=REQUIRED[name])
    time = PARTITIONS.get(name)
    if time:
        rows = rows.withColumn("day", F.to_date(time))
        rows.repartition("site_id", "day").sortWithinPartitions("day", "site_id", time) \
            .write.mode(mode).partitionBy("day").parquet(f"{root}/{name}")
    else:
        rows.write.mode(mode).parquet(f"{root}/{name}")


def write_bronze(df: DataFrame, root: str, name: str, batch_id: str, ingested_at: Column) -> None:
    """Idempotent full replace: loading the same input twice leaves the same rows."""
    write_table(df.withColumns({"ingested_at": ingested_at, "batch_id": F.lit(batch_id)}), root, name)


def write_silver(df: DataFrame, root: str, name: str, sensor: str = "room") -> None:
    if name == "readings":
        tag = F.coalesce("sensor", F.lit(sensor)) if "sensor" in df.columns else F.lit(sensor)
        df = df.withColumn("sensor", tag)
    write_table(df, root, name)


write_gold = write_table


def read_layer(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}").select(*SCHEMAS[name])


def scan_since(df: DataFrame, ts: str, since: str | None = None,
               sensor: str | None = None) -> DataFrame:
    """Optional sensor and start filters; both reach the Parquet scan."""
    if sensor is not None:
        df = df.filter(F.col("sensor") == sensor)
    if since is not None:
        df = df.filter(F.col(ts) >= F.lit(since).cast("timestamp_ntz"))
    return df


def read_gold(spark: SparkSession, root: str, name: str, since: str | None = None,
              horizon: str | None = None) -> DataFrame:
    df = read_layer(spark, root, name)
    if since is not None:
        df = df.filter(F.col("timestamp") >= F.lit(since).cast("timestamp_ntz"))
    if horizon is not None:
        df = df.filter(F.col("horizon") == horizon)
    order = {"episodes": [F.col("start").desc()], "hourly": ["timestamp"],
             "forecast_points": ["timestamp"]}.get(name)
    return df.orderBy(*order) if order else df


def ingest_watermark(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per source: latest time (NULL when empty) and rows."""
    parts = [df.agg(F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("rows_ingested"))
             .select(F.lit(name).alias("table_name"), "last_ts", "rows_ingested")
             for name, (df, ts) in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def gold_meta(readings: DataFrame, keys: Sequence[str], stored: DataFrame | None = None,
              ts: str = "ts") -> DataFrame:
    """Observation bounds per key; a stored value wins over the one derived from readings."""
    bounds = observation_bounds(readings, keys, ts).withColumn("shift_days", F.lit(0.0))
    if stored is None:
        return bounds
    kept = stored.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("last_ts", "span_days", "shift_days")])
    joined = bounds.join(kept, list(keys), "full")
    return joined.select(*keys, *[F.coalesce(f"_{c}", c).alias(c)
                                  for c in ("last_ts", "span_days", "shift_days")])


def layer_volumes(tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """Rows per present table, and continuous segments where a table has them."""
    parts = []
    for name, df in tables.items():
        if df is None:
            continue
        segments = F.lit(None).cast("bigint")
        if "segment_id" in df.columns:
            segments = F.sum((F.col("segment_position") == 0).cast("bigint"))
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows"), segments.alias("segments"))
                     .select(F.lit(name).alias("table_name"), "n_rows", "segments"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def missing_tables(spark: SparkSession, root: str, names: Sequence[str] = tuple(GOLD)) -> list[str]:
    return [n for n in names if not _exists(spark, f"{root}/{n}")]


def export_gold(spark: SparkSession, source: str, target: str,
                shift_to: str | None = None) -> DataFrame:
    """Copy the gold tables, optionally moved in time as one block, statuses refreshed.

    All time columns move by one delta that brings each site's last scored hour to
    ``shift_to`` floored to the hour; the end of observation may not pass ``shift_to``.
    Returns rows per exported table.
    """
    absent = missing_tables(spark, source, [n for n in GOLD if n != "gold_meta"])
    if absent:
        raise FileNotFoundError(f"gold tables missing in {source}: {absent}")
    tables = {n: read_layer(spark, source, n) for n in GOLD if n != "gold_meta"}
    stored = None if missing_tables(spark, source, ["gold_meta"]) else read_layer(spark, source, "gold_meta")
    if missing_tables(spark, source, ["readings"]):
        if stored is None:
            raise FileNotFoundError("neither readings nor stored bounds to date the export with")
        meta = stored
    else:
        meta = gold_meta(read_layer(spark, source, "readings"), ["site_id"], stored)
    if shift_to is not None:
        now = F.lit(shift_to).cast("timestamp_ntz")
        delta = tables["hourly"].groupBy("site_id").agg(F.max("timestamp").alias("_a")).select(
            "site_id", anchor_delta(now, "_a").alias("_delta"))
        if delta.isEmpty():
            raise ValueError("cannot shift: no scored hours")
        tables = {n: shift_time(df.join(delta, "site_id"), GOLD_TIMES[n], F.col("_delta")).drop("_delta")
                  for n, df in tables.items()}
        meta = shift_time(meta.join(delta, "site_id"), ["last_ts"], F.col("_delta"),
                          clamp={"last_ts": now}).withColumn(
            "shift_days", F.round(F.col("_delta") / 86400, 3)).drop("_delta")
    tables["gold_meta"] = meta
    ref = meta.select("site_id", F.col("last_ts").alias("_ref"))
    tables["episodes"] = refresh_status(tables["episodes"].join(ref, "site_id", "left"),
                                        F.col("_ref")).drop("_ref")
    for name, df in tables.items():
        write_gold(df, target, name)
    return layer_volumes({n: read_layer(spark, target, n) for n in GOLD})


def import_gold(spark: SparkSession, source: str, target: str,
                replace_existing: bool = False) -> DataFrame:
    """Load an exported snapshot; refuses missing tables and, by default, filled targets."""
    absent = missing_tables(spark, source)
    if absent:
        raise ValueError(f"snapshot lacks tables: {', '.join(absent)}")
    filled = [n for n in GOLD if not missing_tables(spark, target, [n])
              and not read_layer(spark, target, n).isEmpty()]
    if filled and not replace_existing:
        raise RuntimeError(f"target already holds {', '.join(filled)}; pass replace_existing")
    for name in GOLD:
        write_gold(read_layer(spark, source, name), target, name)
    return layer_volumes({n: read_layer(spark, target, n) for n in GOLD})
