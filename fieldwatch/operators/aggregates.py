"""Alarm-event features, state statistics, rollups and top-k."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import finite, flag
from ..functions.time import epoch_us
from .quantiles import exact_quantiles
from .ranks import running_totals


def _mentions(msg: str, words: Sequence[str]) -> Column:
    text, hit = F.upper(F.coalesce(F.col(msg), F.lit(""))), F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def event_features(df: DataFrame, event_keys: Sequence[str], ts: str, msg: str,
                   state: str) -> DataFrame:
    """One row per alarm event; ratios are NULL where they would be infinite."""
    count_if = lambda cond: F.sum(flag(F.coalesce(cond, F.lit(False))))
    # alarms of one event and message meet map-side first; distinct messages are then a count
    per = df.groupBy(*event_keys, msg).agg(
        F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.count(msg).alias("_n"),
        count_if(F.col(state) == "A").alias("_a"), count_if(F.col(state) == "D").alias("_d"),
        *[count_if(_mentions(msg, words)).alias(f"_k_{n}")
          for n, words in K.EVENT_KEYWORDS.items()])
    ev = per.groupBy(*event_keys).agg(
        F.min("_lo").alias("start_time"), F.max("_hi").alias("end_time"),
        F.sum("_n").alias("total_alarms"), F.count(msg).alias("unique_alarm_types"),
        F.sum("_a").alias("active_alarms"), F.sum("_d").alias("cleared_alarms"),
        *[F.sum(f"_k_{n}").alias(f"{n}_alarm_count") for n in K.EVENT_KEYWORDS])
    c = F.col
    ev = ev.withColumn("duration_sec", (epoch_us("end_time") - epoch_us("start_time")) / F.lit(1e6))
    ratio = lambda a, b: F.when(b != 0, a / b)
    ev = ev.withColumns({
        "hour": F.hour("start_time"), "weekday": F.weekday("start_time"),
        "month": F.month("start_time"),
        "alarm_diversity": ratio(c("unique_alarm_types"), c("total_alarms")),
        "active_ratio": c("active_alarms") / (c("active_alarms") + c("cleared_alarms") + F.lit(1e-6)),
        "alarm_rate": c("total_alarms") / (c("duration_sec") + 1),
        "complexity": c("unique_alarm_types") * c("duration_sec"),
        "ups_ratio": ratio(c("ups_alarm_count"), c("total_alarms")),
        "generator_present": flag(c("generator_alarm_count") > 0),
        "repetition_factor": ratio(c("total_alarms"), c("unique_alarm_types"))})
    ev = ev.withColumn("event_intensity", c("alarm_rate") * c("unique_alarm_types"))
    return ev.withColumns({n: finite(n) for n in ("alarm_diversity", "active_ratio", "alarm_rate",
                                                  "complexity", "ups_ratio", "repetition_factor",
                                                  "event_intensity")})


def dominant(df: DataFrame, keys: Sequence[str], col: str, out: str | None = None) -> DataFrame:
    """Most frequent value per group; the smallest name wins a tie."""
    counts = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        F.min_by(col, F.struct(-F.col("_n"), F.col(col))).alias(out or f"dominant_{col}"))


def state_stats(df: DataFrame, state: str, keys: Sequence[str],
                bounds: Mapping[str, tuple[str | float, str | float]]) -> DataFrame:
    """Rows per state and the share of them at or past the upper / lower bound."""
    at = lambda x: F.col(x) if isinstance(x, str) else F.lit(float(x))
    share = lambda cond: F.avg(flag(F.coalesce(cond, F.lit(False))))
    cols = []
    for c, (low, high) in bounds.items():
        cols += [share(F.col(c) >= at(high)).alias(f"prop_{c}_high"),
                 share(F.col(c) <= at(low)).alias(f"prop_{c}_low")]
    return df.groupBy(*keys, state).agg(F.count(F.lit(1)).alias("n_points"), *cols)


def status_counts(eps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return eps.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"))


def top_contributor(df: DataFrame, by: str, keys: Sequence[str] = ()) -> DataFrame:
    counts = df.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct(F.col(by), F.col("n")), F.struct(-F.col("n"), F.col(by)))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def fleet_rollup(sites: DataFrame, site: str = "site_id", score: str = "score",
                 assets: str = "assets", anomalies: str = "anomalies",
                 pm_days: str = "pm_days") -> DataFrame:
    """One fleet row: rounded mean score, totals, the worst site and the soonest maintenance."""
    return sites.agg(
        F.floor(F.avg(score) + 0.5).cast("bigint").alias("mean_score"),
        F.sum(assets).alias("assets"), F.sum(anomalies).alias("anomalies"),
        F.min_by(site, F.struct(score, site)).alias("worst_site"),
        F.min_by(site, F.struct(pm_days, site)).alias("soonest_pm_site"),
        F.min(pm_days).alias("soonest_pm_days"))


def rank_sites(sites: DataFrame, score: str = "score", ts: str = "site_id") -> DataFrame:
    """Most at risk first.  Equal scores share a rank.

    Ranks come from running totals over the distinct scores, so the fleet is not ordered in one task.
    """
    dist = sites.groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running_totals(dist, [], [score], "_n").select(score, (F.col("_before") + 1).alias("risk_rank"))
    return sites.join(ranks, score)


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def recent(df: DataFrame, ts: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """The ``n`` newest rows of the whole table (top-k per task, merged)."""
    return df.orderBy(F.col(ts).desc(), *ties).limit(n)


def tail(df: DataFrame, keys: Sequence[str], ts: str, n: int) -> DataFrame:
    """Last ``n`` rows per key; the rank limit is applied before the shuffle as well."""
    rk = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(ts).desc()))
    return df.withColumn("_rk", rk).filter(F.col("_rk") <= n).drop("_rk")


def latest(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*df.columns), ts).alias("_row")).select("_row.*")


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    for df in others:
        first = first.unionByName(df)
    return first


def doubles(cols: Sequence[str]) -> Column:
    """The columns as one array of doubles."""
    return F.expr(f"array({', '.join(f'cast(`{c}` AS double)' for c in cols)})")


def feature_medians(train: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Exact medians of gridded features, one row per key (finite values only; null where there are none).

    One row per key, feature and value goes through the distributed quantiles, so no task holds the
    values of a key.
    """
    long = train.select(*keys, F.posexplode(doubles(cols)).alias("_feature", "_value")).withColumn("_value", finite("_value"))
    medians = exact_quantiles(long, [*keys, "_feature"], "_value", [0.5])
    # one array per key in the order of ``cols``: an aggregate per column takes longer to plan than all else
    found = medians.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_feature", "quantile"))).alias("_m"))
    row = F.transform(F.sequence(F.lit(0), F.lit(len(cols) - 1)), lambda i: F.try_element_at("_m", i))
    wide = found.select(*keys, row.alias("_m")).select(*keys, *[F.expr(f"_m[{i}] AS `{c}`") for i, c in enumerate(cols)])
    return train.select(*keys).distinct().join(wide, list(keys), "left") if keys else wide


def impute_median(df: DataFrame, medians: DataFrame, keys: Sequence[str],
                  cols: Sequence[str]) -> DataFrame:
    known = medians.select(*keys, doubles(cols).alias("_m"))
    joined = df.join(known, list(keys), "left") if keys else df.withColumn("_m", known.scalar())
    place, inf = {c: i for i, c in enumerate(cols)}, "double('Infinity')"
    sound = "CASE WHEN NOT (isnan(double(`{c}`)) OR abs(double(`{c}`)) = {inf}) THEN double(`{c}`) END"   # as `finite`, in one text for each column
    return joined.select(*[F.expr(f"coalesce({sound.format(c=c, inf=inf)}, _m[{place[c]}]) AS `{c}`") if c in place else F.col(f"`{c}`")
                           for c in joined.columns if c != "_m"])
