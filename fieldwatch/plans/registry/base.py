"""Stand-in tables, shared SQL definitions and the registration decorator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ... import constants as K
from ...operators.timeblocks import fitting_width
from ...session import prepare

SITES = 4
GAP = 3600.0          # seconds; the driver's readings are far sparser than 2 minutes
BLOCK = 5 * 86_400.0  # time-block width that suits that gap; dense readings take narrower ones, see `block`
KEYS = ["site_id"]
EXIT_REACH = GAP * (K.HYSTERESIS_EXIT_ROWS - 1)   # what a hysteresis looks back on


@dataclass
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    needs: str = ""
    body: str | None = None
    floats: str = ""

    @property
    def sql(self) -> str | None:
        return sql(self.needs, self.body, self.floats) if self.body else None


ENTRIES: dict[str, Entry] = {}
_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: str, body: str) -> None:
    _CTES[name] = (tuple(needs.split()), body)


def sql(needs: str, body: str, floats: str = "") -> str:
    """``WITH`` list of everything ``needs`` depends on, then ``body``; floats rounded as in :func:`rounded`."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in _CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)
    for name in needs.split():
        visit(name)
    if floats:
        swaps = ", ".join(f"round_even({c} * 1000000 + 0.0001::DOUBLE, 0) / 1000000 + 0 AS {c}" for c in floats.split())
        body = f"SELECT * REPLACE ({swaps}) FROM ({body})"
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({_CTES[n][1]})" if not n.startswith("rec_")
                      else f"{n} AS ({_CTES[n][1]})" for n in order)
    return f"WITH RECURSIVE {ctes}\n{body}"


def rounded(df: DataFrame) -> DataFrame:
    """Comparison form: doubles to 6 digits, no negative zero.

    Exact ties at the seventh digit are common and the last bit of a sum is not, so both sides round the
    scaled value a ten-thousandth of a unit above it: a tie goes up whatever its last bit.
    """
    return df.select(*[(F.rint(F.col(f"`{c}`") * 1e6 + 1e-4) / 1e6 + F.lit(0.0)).alias(c) if t == "double"
                       else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, needs: str | None = None, body: str | None = None, floats: str = ""):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        ENTRIES[name] = Entry(lambda spark, sf: rounded(fn(prepare(spark), sf)),
                              needs or "", body, floats)
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


# --- stand-ins --------------------------------------------------------------------------
def readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % SITES).alias("site_id"), "ts",
        F.col("value").alias("temperature"),
        F.get_json_object("props", "$.k").try_cast("double").alias("humidity"))


def block(spark: SparkSession, sf: str, least: float = 0.0) -> float:
    """``BLOCK``, or the part of it that holds few enough of the readings; not below the look-back ``least``."""
    return fitting_width(readings(spark, sf).select(*KEYS, "ts"), KEYS, "ts", BLOCK, least)


cte("readings", "", """
SELECT event_id, user_id % 4 AS site_id, ts, value AS temperature,
       TRY_CAST(regexp_extract(props, '"k": *(-?[0-9.]+)', 1) AS DOUBLE) AS humidity
FROM events""")


def alarms(spark: SparkSession, sf: str) -> DataFrame:
    return alarm_rows(table(spark, sf, "events"))


def alarm_rows(rows: DataFrame) -> DataFrame:
    """Alarm log from events, batch or stream."""
    kind, n = F.col("event_type"), F.col("event_id")
    message = (F.when(kind == "error", "ABSENCE DE TENSION")
               .when((kind == "purchase") & (n % 3 == 0), "ATS TRANSFER")
               .when(kind == "purchase", "RECTIFIER SUPPLY FAULT")
               .when((kind == "view") & (n % 5 == 0), "Battery disconnected")
               .when(kind == "view", "UPS CHECK BATTERY")
               .when((kind == "click") & (n % 3 == 0), "Low battery")
               .when(kind == "click", "Battery discharge, STATS ok")
               .otherwise("Diesel generator start"))
    state = F.when(n % 10 == 0, "X").when(n % 2 == 0, "A").otherwise("D")
    return rows.select(
        "event_id", (F.col("user_id") % SITES).alias("site_id"), state.alias("state"),
        F.col("ts").alias("log_time"), message.alias("message"), F.col("ts").alias("send_time"))


cte("alarms", "", """
SELECT event_id, user_id % 4 AS site_id,
       CASE WHEN event_id % 10 = 0 THEN 'X' WHEN event_id % 2 = 0 THEN 'A' ELSE 'D' END AS state,
       ts AS log_time,
       CASE WHEN event_type = 'error' THEN 'ABSENCE DE TENSION'
            WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'ATS TRANSFER'
            WHEN event_type = 'purchase' THEN 'RECTIFIER SUPPLY FAULT'
            WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'Battery disconnected'
            WHEN event_type = 'view' THEN 'UPS CHECK BATTERY'
            WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'Low battery'
            WHEN event_type = 'click' THEN 'Battery discharge, STATS ok'
            ELSE 'Diesel generator start' END AS message,
       ts AS send_time
FROM events""")


def schedule(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    unit = F.when(k % 3 == 0, "days").when(k % 3 == 1, "weeks").otherwise("months")
    return table(spark, sf, "orders").select(
        F.format_string("PM-%04d", k).alias("id"), F.col("o_custkey").alias("site_id"),
        F.concat(F.lit("U"), F.col("o_custkey") % 14).alias("equipment"),
        F.to_date("o_orderdate").alias("last_pm_date"), (k % 6 + 1).cast("int").alias("period_value"),
        unit.alias("period_unit"))


cte("schedule", "", """
SELECT printf('PM-%04d', o_orderkey) AS id, o_custkey AS site_id,
       'U' || CAST(o_custkey % 14 AS VARCHAR) AS equipment, CAST(o_orderdate AS DATE) AS last_pm_date,
       CAST(o_orderkey % 6 + 1 AS INTEGER) AS period_value,
       CASE o_orderkey % 3 WHEN 0 THEN 'days' WHEN 1 THEN 'weeks' ELSE 'months' END AS period_unit
FROM orders""")
