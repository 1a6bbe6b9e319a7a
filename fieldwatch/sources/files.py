"""Text sources: sensor exports, alarm logs, UPS event lists.

Scanning (distributed CSV read, everything as text, no inference pass) is kept apart from
parsing, so that the same parsing runs on any DataFrame of text columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import to_double
from ..operators.cleaning import categorise, dedupe_first

ALARM_COLUMNS = ["state", "log_time", "message", "send_time"]
DAY_FIRST = ["dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss"]


def scan_text_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                  header: bool = True, encoding: str = "ISO-8859-1") -> DataFrame:
    """All-text CSV scan.  Without ``columns`` Spark reads only the header line for names."""
    reader = spark.read.option("header", header).option("encoding", encoding).option(
        "mode", "PERMISSIVE")
    if columns:
        reader = reader.schema(", ".join(f"`{c}` STRING" for c in columns)).option(
            "enforceSchema", True)
    return reader.csv(path)


def first_parsed(text: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in patterns]).cast("timestamp_ntz")


def day_first(date: str, time: str) -> Column:
    return first_parsed(F.concat_ws(" ", F.trim(date), F.trim(time)), DAY_FIRST)


def parse_readings(raw: DataFrame, site_id: str | Column, sensor: str) -> DataFrame:
    """Text export with ``date, time, temperature, humidity`` under untidy headers."""
    tidy = raw.toDF(*[c.strip().lower() for c in raw.columns]).withColumnsRenamed(
        {"humidité": "humidity"})
    site = F.lit(site_id) if isinstance(site_id, str) else site_id
    rows = tidy.withColumn("ts", day_first("date", "time")).filter(F.col("ts").isNotNull())
    return rows.select(site.alias("site_id"), "ts", to_double("temperature").alias("temperature"),
                       to_double("humidity").alias("humidity"), F.lit(sensor).alias("sensor"))


def read_readings(spark: SparkSession, path: str, site_id: str, sensor: str) -> DataFrame:
    return parse_readings(scan_text_csv(spark, path), site_id, sensor)


def parse_alarm_log(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed({"time": "log_time", "send Time": "send_time"}).select(
        *ALARM_COLUMNS)


def read_alarm_log(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Alarm log whose first line is a false header; the real one repeats the column names."""
    raw = scan_text_csv(spark, path, columns)
    is_header = F.lit(True)
    for c in columns:
        is_header = is_header & (F.trim(F.col(c)) == c)
    return parse_alarm_log(raw.filter(~F.coalesce(is_header, F.lit(False))))


def parse_ups_events(raw: DataFrame, prefix: str, date: str = "Date", time: str = "Time",
                     description: str = "Description") -> DataFrame:
    """Descriptions -> state (D when restored) and message (prefix + upper-case text)."""
    text = F.coalesce(F.col(description), F.lit(""))
    at = day_first(date, time)
    restored = F.lower(text).contains("restored")
    message = F.concat(F.lit(prefix), F.upper(F.regexp_replace(text, "(?i) has been restored", "")))
    return raw.select(F.when(restored, "D").otherwise("A").alias("state"), at.alias("log_time"),
                      message.alias("message"), at.alias("send_time"))


def read_ups_events(spark: SparkSession, path: str, prefix: str,
                    columns: Sequence[str] = ("Date", "Time", "Description")) -> DataFrame:
    """UPS list with one junk line above the header; both lines are dropped by content."""
    raw = scan_text_csv(spark, path, columns, header=False)
    real = F.coalesce(F.trim(F.col(columns[0])) != columns[0], F.lit(False))
    parsed = parse_ups_events(raw.filter(real), prefix)
    return parsed.filter(F.col("log_time").isNotNull())


def filter_site(df: DataFrame, token: str, message: str = "message") -> DataFrame:
    return df.filter(F.lower(F.coalesce(F.col(message), F.lit(""))).contains(token.lower()))


def union_alarms(*dfs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Union of raw alarm sources with times coerced; rows without a log time are dropped."""
    cols = [*keys, *ALARM_COLUMNS]
    out = dfs[0].select(*cols)
    for df in dfs[1:]:
        out = out.unionByName(df.select(*cols))
    times = {c: F.col(c).cast("string").try_cast("timestamp_ntz") for c in ("log_time", "send_time")}
    return out.withColumns(times).filter(F.col("log_time").isNotNull())


def load_alarms_clean(*dfs: DataFrame, keys: Sequence[str] = (),
                      order: Sequence[str] = ("send_time", "state")) -> DataFrame:
    """Union, first row per ``(log_time, message)``, category."""
    rows = union_alarms(*dfs, keys=keys).na.drop(subset=["message"])
    return categorise(dedupe_first(rows, [*keys, "log_time", "message"], order), "message")
