"""Hourly health scoring (H1-H18, A18) on the ``(site, hour)`` grid."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import clip, finite, flag, present
from ..functions.time import epoch_us
from .cleaning import dedupe_last, keyword_flags, null_implausible
from .hourgrid import HOUR, hourly_counts, hourly_readings, interpolate
from .segments import run_length
from .windows import decayed_sums, trend_volatility, zscore_burden


def _positive(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))


def _p95(keys: Sequence[str], c: str) -> Column:
    return F.percentile(_positive(c), F.lit(0.95)).over(W.partitionBy(*keys))


def p95_norm(df: DataFrame, keys: Sequence[str], cols: Mapping[str, str]) -> DataFrame:
    """``out -> col``: positive part over its 95th percentile, at most 1 (0 without signal)."""
    return df.withColumns({out: F.when(_p95(keys, c) > 0, F.least(
        _positive(c) / _p95(keys, c), F.lit(1.0))).otherwise(0.0) for out, c in cols.items()})


def saturate(df: DataFrame, keys: Sequence[str], cols: Mapping[str, str],
             scale: float | None = None) -> DataFrame:
    """``out -> col``: ``1 - exp(-x / scale)``; the scale defaults to the 95th percentile."""
    def ratio(c: str) -> Column:
        s = F.lit(float(scale)) if scale is not None else _p95(keys, c)
        return F.when(s > 0, 1 - F.exp(-_positive(c) / s)).otherwise(0.0)
    return df.withColumns({out: ratio(c) for out, c in cols.items()})


def pm_risk(ts: str | Column, last_pm: Column, interval_days: float) -> Column:
    """Days since the last maintenance over the interval, within [0, 1]."""
    days = (epoch_us(ts) - epoch_us(last_pm)) / F.lit(86_400e6)
    return F.least(F.greatest(days, F.lit(0.0)) / F.lit(float(interval_days)), F.lit(1.0))


def env_terms(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    df = df.withColumns({
        "temp_term": clip((F.col("temperature") - 26) / 10, 0.0, 1.0),
        "humidity_term": clip((F.abs(F.col("humidity") - 46) - 4) / 15, 0.0, 1.0)})
    return p95_norm(df, keys, {"temp_change_term": "temp_std_1h",
                               "humidity_change_term": "humidity_std_1h"})


def environment_hourly(readings: DataFrame, keys: Sequence[str], ts: str,
                       order: Sequence[str]) -> DataFrame:
    """Readings -> one row per hour with terms and anomaly burden."""
    clean = null_implausible(dedupe_last(
        readings.select(*dict.fromkeys([*keys, ts, "temperature", "humidity", *order])),
        keys, ts, order))
    hourly = interpolate(hourly_readings(clean, keys, ts), keys, HOUR, ["temperature", "humidity"])
    hourly = hourly.withColumns({c: F.coalesce(c, F.lit(0.0))
                                 for c in ("temp_std_1h", "humidity_std_1h")})
    return zscore_burden(env_terms(hourly, keys), keys, HOUR,
                         {"temperature": "temp", "humidity": "humidity"})


def energy_terms(hourly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Loads, outage duration and risk terms from hourly counts that already carry loads."""
    names = list(K.ENERGY_FLAGS.values())
    hourly = hourly.withColumn("outage_active_hour", flag(F.col("outage_count") > 0))
    hourly = run_length(hourly, keys, HOUR, "outage_active_hour", "outage_duration_hours")
    hourly = hourly.withColumn("total_energy_load",
                               sum((F.col(f"{n}_load") for n in names), F.lit(0.0)))
    hourly = saturate(hourly, keys, {**{f"{n}_term": f"{n}_load" for n in names},
                                     "energy_frequency_anomaly": "total_energy_load"})
    return saturate(hourly, keys, {"persistence_term": "outage_duration_hours",
                                   "energy_duration_anomaly": "outage_duration_hours"},
                    K.DURATION_SCALE_HOURS)


def battery_terms(hourly: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = list(K.BATTERY_FLAGS.values())
    hourly = run_length(hourly, keys, HOUR, "battery_alarm_active", "battery_alarm_duration_hours")
    hourly = saturate(hourly, keys, {f"{n}_component": f"{n}_load"
                                     for n in [*names, "recurrence"]})
    hourly = saturate(hourly, keys, {"persistence_component": "battery_alarm_duration_hours"},
                      K.DURATION_SCALE_HOURS)
    return hourly.withColumn("battery_anomaly_burden", clip(
        0.5 * F.col("persistence_component") + 0.5 * F.col("recurrence_component"), 0.0, 1.0))


def alarm_loads(alarms: DataFrame, keys: Sequence[str], ts: str, energy: bool = True,
                battery: bool = True) -> DataFrame:
    """Flagged alarms -> dense hourly counts and decayed loads, both domains in one pass."""
    flags = {**(K.ENERGY_FLAGS if energy else {}), **(K.BATTERY_FLAGS if battery else {})}
    hourly = hourly_counts(alarms, keys, ts, flags)
    loads = {f"{n}_load": f"{n}_count" for n in flags.values()}
    if battery:
        active = sum((F.col(f"{n}_count") for n in K.BATTERY_FLAGS.values()), F.lit(0)) > 0
        hourly = hourly.withColumn("battery_alarm_active", flag(active))
        loads["recurrence_load"] = "battery_alarm_active"
    return decayed_sums(hourly, keys, HOUR, loads, K.HALF_LIFE_HOURS)


def energy_hourly(alarms: DataFrame, keys: Sequence[str], ts: str = "log_time") -> DataFrame:
    return energy_terms(alarm_loads(alarms, keys, ts, battery=False), keys)


def battery_hourly(alarms: DataFrame, keys: Sequence[str], ts: str = "log_time") -> DataFrame:
    return battery_terms(alarm_loads(alarms, keys, ts, energy=False), keys)


def check_weights(weights: Mapping[str, Mapping[str, float]], tolerance: float = 1e-6) -> None:
    """Fail, naming the group, unless every group is complete, numeric, >= 0 and sums to 1."""
    for group, expected in K.WEIGHTS.items():
        if group not in weights:
            raise ValueError(f"weight group {group!r} is missing")
        given = weights[group]
        absent = sorted(set(expected) - set(given))
        if absent:
            raise ValueError(f"weight group {group!r} lacks {absent}")
        for key in expected:
            value = given[key]
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise ValueError(f"weight {group}.{key} is not a number: {value!r}")
            if not math.isfinite(value) or value < 0:
                raise ValueError(f"weight {group}.{key} must be finite and not negative")
        total = sum(given[key] for key in expected)
        if abs(total - 1.0) > tolerance:
            raise ValueError(f"weight group {group!r} sums to {total:.6f}, not 1")


def active_terms(df: DataFrame, keys: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """Per key: does each term ever exceed 0?"""
    return df.groupBy(*keys).agg(*[
        F.coalesce(F.max(t) > 0, F.lit(False)).alias(f"{t}_active") for t in terms])


def base_risk(df: DataFrame, keys: Sequence[str], weights: Mapping[str, float],
              out: str, mean_of_active: str | None = None) -> DataFrame:
    """Weighted sum of the terms that carry any signal for the key, weights renormalised.

    A key without any signal has no base risk and is refused, as a wrong all-healthy score
    would be worse.
    """
    site = W.partitionBy(*keys)
    df = df.withColumns({f"_on_{t}": F.coalesce(F.max(t).over(site) > 0, F.lit(False))
                         for t in weights})
    used = lambda t, x: F.when(F.col(f"_on_{t}"), x).otherwise(0.0)
    total = sum((used(t, F.lit(float(w))) for t, w in weights.items()), F.lit(0.0))
    raw = sum((used(t, F.lit(float(w)) * F.col(t)) for t, w in weights.items()), F.lit(0.0))
    checked = F.when(total > 0, raw / total).otherwise(F.raise_error(F.lit(
        f"{out}: no term carries a signal")).cast("double"))
    df = df.withColumn(out, clip(100 * checked, 0.0, 100.0))
    if mean_of_active:
        seen = [F.when(F.col(f"_on_{t}"), F.col(t)) for t in weights]
        n = sum((flag(s.isNotNull()) for s in seen), F.lit(0))
        s = sum((F.coalesce(x, F.lit(0.0)) for x in seen), F.lit(0.0))
        df = df.withColumn(mean_of_active, clip(s / n, 0.0, 1.0))
    return df.drop(*[f"_on_{t}" for t in weights])


def final_risk(base: Column, burden: Column, pm: Column, wa: float, wm: float) -> Column:
    return clip(base * (1 + wa * clip(burden, 0.0, 1.0)) * (1 + wm * clip(pm, 0.0, 1.0)),
                0.0, 100.0)


def domain_scores(df: DataFrame, keys: Sequence[str], domain: str,
                  weights: Mapping[str, float], last_pm: Column | None = None,
                  interval_days: float | None = None) -> DataFrame:
    """Base, maintenance and final risk plus health of one domain."""
    default_pm, default_days = K.PM_DEFAULTS[domain]
    if last_pm is None:
        last_pm = (F.lit(default_pm).cast("timestamp_ntz") if default_pm
                   else F.min(HOUR).over(W.partitionBy(*keys)))
    df = base_risk(df, keys, weights, f"{domain}_base_risk",
                   "energy_sequence_anomaly" if domain == "energy" else None)
    if domain == "energy":
        df = df.withColumn("energy_anomaly_burden", clip(
            0.40 * F.col("energy_frequency_anomaly") + 0.35 * F.col("energy_duration_anomaly")
            + 0.25 * F.col("energy_sequence_anomaly"), 0.0, 1.0))
    df = df.withColumn(f"{domain}_pm_risk", pm_risk(HOUR, last_pm, interval_days or default_days))
    wa, wm = K.MULTIPLIERS[domain]
    df = df.withColumn(f"{domain}_risk_score", final_risk(
        F.col(f"{domain}_base_risk"), F.col(f"{domain}_anomaly_burden"),
        F.col(f"{domain}_pm_risk"), wa, wm))
    return df.withColumn(f"{domain}_health_score", 100 - F.col(f"{domain}_risk_score"))


def calibrate_energy(df: DataFrame) -> DataFrame:
    """Soft compression of the energy risk, with a floor under persistent outages."""
    raw = clip(F.coalesce(finite("energy_risk_score"), F.lit(0.0)), 0.0, 100.0)
    soft = clip(100 * (1 - F.exp(-raw / K.ENERGY_COMPRESSION)), 0.0, 100.0)
    hours = _positive("outage_duration_hours")
    other = lambda n: _positive(n) if n in df.columns else F.lit(0.0)
    severe = (hours >= 4) | ((hours >= 2) & ((other("generator_hours") >= 2)
                                             | (other("power_transfer_hours") >= 3)))
    floor = F.least(K.ENERGY_FLOOR + 3 * F.greatest(hours - 4, F.lit(0.0)), F.lit(100.0))
    risk = F.when(severe, F.greatest(soft, floor)).otherwise(soft)
    return (df.withColumn("energy_risk_score_raw", F.col("energy_risk_score"))
              .withColumn("energy_health_score_raw", F.col("energy_health_score"))
              .withColumn("energy_risk_score_calibrated", risk)
              .withColumn("energy_health_score_calibrated",
                          100 - F.col("energy_risk_score_calibrated"))
              .withColumn("energy_risk_score", F.col("energy_risk_score_calibrated"))
              .withColumn("energy_health_score", F.col("energy_health_score_calibrated")))


def overall_health(df: DataFrame, weights: Mapping[str, float] = K.WEIGHTS["overall"]) -> DataFrame:
    """Site risk and health, main driver and its share.

    A missing domain risk counts 0 in the overall sum; ``environment_missing`` says so.
    """
    domains = ["environmental", "energy", "battery"]
    df = df.withColumn("environment_missing", F.col("environmental_risk_score").isNull())
    df = df.withColumns({f"{d}_risk_score": clip(
        F.coalesce(finite(f"{d}_risk_score"), F.lit(0.0)), 0.0, 100.0) for d in domains})
    df = df.withColumns({f"{d}_contribution": F.lit(weights[d]) * F.col(f"{d}_risk_score")
                         for d in domains})
    parts = [F.col(f"{d}_contribution") for d in domains]
    df = df.withColumn("overall_site_risk", clip(sum(parts[1:], parts[0]), 0.0, 100.0))
    df = df.withColumn("overall_site_health", 100 - F.col("overall_site_risk"))
    top = F.greatest(*parts)
    driver = F.when(F.col("overall_site_risk") < 5, "None").when(
        parts[0] == top, "Environmental").when(parts[1] == top, "Energy").otherwise("Battery")
    share = F.coalesce(top / F.nullif(F.col("overall_site_risk"), F.lit(0.0)), F.lit(0.0))
    return df.withColumns({"main_risk_driver": driver, "main_driver_share": clip(share, 0.0, 1.0)})


def _level(score: Column, position: int) -> Column:
    rule = F
    for level in K.STATUS_LEVELS:
        rule = rule.when(score < level[0], F.lit(level[position]))
    return rule.otherwise(F.lit(K.STATUS_TOP[position - 1]))


def status_priority(df: DataFrame, score: str = "overall_site_health") -> DataFrame:
    return df.withColumns({"site_health_status": _level(F.col(score), 1),
                           "maintenance_priority": _level(F.col(score), 2)})


def trend_label(df: DataFrame, change: str = "overall_site_health_trend_24h") -> DataFrame:
    c, (small, large) = F.col(change), K.TREND_POINTS
    return df.withColumn("health_trend_status", F.when(c <= -large, "Rapidly Deteriorating").when(
        c <= -small, "Deteriorating").when(c >= large, "Rapidly Improving").when(
        c >= small, "Improving").otherwise("Stable"))


#: Stable codes of the recommended action; a caller brings the wording for its readers.
ADVICE = {code: code for code in (
    "routine", "battery_urgent", "battery_check", "battery_review", "energy_urgent", "energy_check", "energy_review",
    "cooling", "humidity", "ambient", "review")}


def recommend(df: DataFrame, wording: Mapping[str, str] | None = None) -> DataFrame:
    """Decision table: health, then driver, then how long or how far it is out of range.

    ``recommended_action`` is a code of ``ADVICE``, or its text where ``wording`` has one.
    """
    say = {k: F.lit((wording or {}).get(k, v)) for k, v in ADVICE.items()}
    driver, outage = F.col("main_risk_driver"), _positive("outage_duration_hours")
    battery = _positive("battery_alarm_duration_hours")
    dry_or_damp = (F.col("humidity") < 35) | (F.col("humidity") > 60)
    return df.withColumn(
        "recommended_action",
        F.when(F.col("overall_site_health") >= K.HEALTHY_MIN, say["routine"])
        .when(driver == "Battery", F.when(battery >= 12, say["battery_urgent"])
              .when(battery >= 4, say["battery_check"]).otherwise(say["battery_review"]))
        .when(driver == "Energy", F.when(outage >= 4, say["energy_urgent"])
              .when(outage >= 1, say["energy_check"]).otherwise(say["energy_review"]))
        .when(driver == "Environmental", F.when(F.col("temperature") > 30, say["cooling"])
              .when(dry_or_damp, say["humidity"]).otherwise(say["ambient"]))
        .otherwise(say["review"]))


def confidence(df: DataFrame) -> DataFrame:
    few = F.when(F.col("observation_count") < 10, 15).otherwise(0)
    blind = F.when(F.col("humidity").isNull(), 20).otherwise(0)
    return df.withColumn("score_confidence", (F.lit(100) - few - blind).cast("double"))


def health_scores(readings: DataFrame, alarms: DataFrame, keys: Sequence[str],
                  weights: Mapping[str, Mapping[str, float]] = K.WEIGHTS,
                  reading_ts: str = "ts", alarm_ts: str = "log_time",
                  reading_order: Sequence[str] = ("ts",), strict: bool = False) -> DataFrame:
    """The hourly score table over the hours all three sources cover.

    Scales and no-signal tests look at each source's whole range, before the intersection.
    ``strict`` refuses keys whose sources never overlap (one small extra job).
    """
    check_weights(weights)
    env = domain_scores(environment_hourly(readings, keys, reading_ts, reading_order), keys,
                        "environmental", weights["environmental"])
    flagged = keyword_flags(alarms.filter(F.col(alarm_ts).isNotNull()), "message")
    log = battery_terms(energy_terms(alarm_loads(flagged, keys, alarm_ts), keys), keys)
    log = domain_scores(log, keys, "energy", weights["energy"])
    log = domain_scores(log, keys, "battery", weights["battery"])
    # both grids are dense, so the common hours are the hours present in both; one single
    # common hour does not make a period
    joined = env.join(log, [*keys, HOUR])
    joined = joined.withColumn("_hours", F.count(F.lit(1)).over(W.partitionBy(*keys))).filter(
        F.col("_hours") > 1).drop("_hours")
    if strict:
        missing = readings.select(*keys).distinct().join(
            joined.select(*keys).distinct(), list(keys), "left_anti")
        if not missing.isEmpty():
            raise ValueError("no common period between readings and alarms for some keys")
    scored = overall_health(calibrate_energy(joined))
    scored = trend_volatility(scored, keys, HOUR, [*K.SUBSYSTEM_HEALTH, "overall_site_health"],
                              smooth=["overall_site_health"])
    scored = confidence(recommend(trend_label(status_priority(scored))))
    return scored.withColumns({"weight_version": F.lit(K.WEIGHT_VERSION),
                               "score_version": F.lit(K.SCORE_VERSION)})


def api_status(score: Column) -> Column:
    return F.when(score >= K.HEALTHY_MIN, "healthy").when(
        score >= K.WATCH_MIN, "watch").otherwise("critical")


def api_trend(change: Column) -> Column:
    return F.when(change >= K.TREND_POINTS[0], "up").when(
        change <= -K.TREND_POINTS[0], "down").otherwise("stable")


def latest_row(hourly: DataFrame, keys: Sequence[str], ts: str = HOUR) -> DataFrame:
    best = hourly.groupBy(*keys).agg(F.max_by(F.struct(*hourly.columns), ts).alias("_row"))
    return best.select("_row.*")


def snapshot(hourly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last scored hour -> one global row and one row per domain and key."""
    last = latest_row(hourly.select(*keys, HOUR, "overall_site_health", *K.SUBSYSTEM_HEALTH,
                                    "overall_site_health_trend_24h",
                                    *[f"{c}_trend_24h" for c in K.SUBSYSTEM_HEALTH]), keys)
    named = {"global": "overall_site_health", **{c.split("_")[0]: c for c in K.SUBSYSTEM_HEALTH}}
    rows = F.explode(F.array(*[F.struct(
        F.lit("global" if n == "global" else "family").alias("scope"),
        F.lit(None if n == "global" else n).cast("string").alias("family"),
        present(F.col(c), 1).alias("score"), F.col(f"{c}_trend_24h").alias("change"))
        for n, c in named.items()])).alias("r")
    # status is read off the rounded score, so that it never contradicts the shown value
    return last.select(*keys, HOUR, rows).select(
        *keys, HOUR, "r.scope", "r.family", "r.score",
        api_status(F.col("r.score")).alias("status"), api_trend(F.col("r.change")).alias("trend"))
