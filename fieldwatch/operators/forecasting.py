"""The +6 h delta forecast: frame, training, evaluation, recursive unroll."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import clip, finite, flag, present
from ..models import boosting
from ..session import durable_checkpoint
from .aggregates import doubles, feature_medians, impute_median, tail
from .hourgrid import HOUR, regrid, resample_end
from .segments import streaks
from .timeblocks import BLOCK, HALO, carry, row_blocks
from .windows import (base_columns, calendar_features, chrono_split, cross_features, targets,
                      trajectory_columns)

TARGET = "target_health_change_6h"
LABELS = {"target_health_6h", TARGET, "health_change_6h", "major_drop_6h", "severe_drop_6h"}
CALENDAR = ["hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "is_weekend", "month"]
CROSS = ["interaction_energy_battery_risk", "interaction_environmental_energy_risk",
         "interaction_environmental_battery_risk", "interaction_energy_battery_anomaly_burden",
         "max_subsystem_risk", "min_subsystem_health", "subsystem_health_spread",
         "subsystems_below_80", "subsystems_below_60"]
GLOBAL_STREAK = "overall_health_consecutive_decline_hours"   # the name that stored feature lists carry
#: Rows before its own that a feature of bounded look-back may read.
LOOK_BACK = max(*K.HEALTH_LAGS, *K.HEALTH_WINDOWS, *K.SUBSYSTEM_LAGS, *K.HEALTH_CHANGES, *K.TRAJECTORY_LAGS, *K.TRAJECTORY_CHANGES, *K.TRAJECTORY_RATES,
                *K.TRAJECTORY_WINDOWS, *K.TRAJECTORY_SLOPES, *[2 * p for p in K.TRAJECTORY_ACCELERATIONS])
STREAKS = ([GLOBAL_STREAK, *[f"{c}_consecutive_decline_hours" for c in K.SUBSYSTEM_HEALTH]]
           + [f"{c}_consecutive_increase_hours" for c in K.SUBSYSTEM_RISK])


# --- frame ------------------------------------------------------------------------------
def model_frame(hourly: DataFrame, keys: Sequence[str],
                sources: Sequence[str] = tuple(K.TRAJECTORY_SOURCES)) -> tuple[DataFrame, list[str]]:
    """Hourly scores -> features and targets, plus the feature names.

    Nothing is computed that a later ``select`` does not use: Catalyst prunes the generated
    window columns, so a model that keeps 20 features costs 20 features. Only row numbers and streaks are
    taken key by key; features of bounded look-back are taken on blocks of a key's rows.
    """
    missing = [c for c in sources if c not in hourly.columns]
    if missing:
        raise ValueError(f"hourly table lacks forecast sources: {missing}")
    number = F.row_number().over(W.partitionBy(*keys).orderBy(HOUR))
    df = streaks(hourly.withColumn("_i", number), keys, HOUR, ["overall_site_health", *K.SUBSYSTEM_HEALTH], K.SUBSYSTEM_RISK)
    df = df.withColumnRenamed("overall_site_health_consecutive_decline_hours", GLOBAL_STREAK)
    df, part = row_blocks(df, keys, "_i", LOOK_BACK, K.HORIZON_ROWS), [*keys, BLOCK]
    base = base_columns(part, "_i")
    dynamic = {n: e for c in sources for n, e in trajectory_columns(part, "_i", c).items()}
    dynamic = {n: e for n, e in dynamic.items() if n not in base and n not in hourly.columns}
    df = targets(df, part, "_i").withColumns({**base, **dynamic}).filter(~F.col(HALO)).drop("_i", BLOCK, HALO)
    df = calendar_features(cross_features(df), HOUR)
    current = [c for c in K.CURRENT_FEATURES if c in hourly.columns]
    names = list(dict.fromkeys([*current, *base, *dynamic, *STREAKS, *CROSS, *CALENDAR]))
    return df, [n for n in names if n not in LABELS]


def required_sources(features: Sequence[str],
                     sources: Sequence[str] = tuple(K.TRAJECTORY_SOURCES)) -> list[str]:
    """The source variables whose trajectory features appear in ``features`` (exact lineage)."""
    kinds = r"_(?:lag|change|rate|rollmean|rollstd|rollmin|rollmax|rollrange|slope|accel)_\d+h$"
    used = {re.sub(kinds, "", f) for f in features if re.search(kinds, f)}
    return [s for s in sources if s in used]


def usable_rows(frame: DataFrame) -> DataFrame:
    return frame.na.drop(subset=[*K.REQUIRED_FEATURES, TARGET])


def drop_all_null(frame: DataFrame, features: Sequence[str]) -> list[str]:
    """Features with at least one value; one row for each comes back."""
    values = frame.select(F.posexplode(doubles(features)).alias("c", "v")).filter(finite("v").isNotNull())
    seen = {r["c"] for r in values.groupBy("c").agg(F.count("v")).collect()}
    return [f for c, f in enumerate(features) if c in seen]


# --- evaluation -------------------------------------------------------------------------
def eval_delta(df: DataFrame, current: str, actual: str, delta: str | Column,
               keys: Sequence[str] = ()) -> DataFrame:
    """All forecast metrics in one aggregation (health rebuilt as clip(current + delta))."""
    d = F.col(delta) if isinstance(delta, str) else delta
    rows = df.select(*keys, F.col(current).alias("c"), F.col(actual).alias("a"), d.alias("d")) \
             .withColumn("p", clip(F.col("c") + F.col("d"), 0.0, 100.0)) \
             .withColumn("e", F.abs(F.col("a") - F.col("p"))).withColumn("m", F.col("a") - F.col("c"))
    risk, said = F.col("a") < K.HIGH_RISK_BELOW, F.col("p") < K.HIGH_RISK_BELOW
    hit = F.sum(flag(risk & said))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("e").alias("mae"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        (1 - F.sum(F.col("e") * F.col("e")) / F.nullif(F.var_pop("a") * F.count("a"), F.lit(0.0))).alias("r2"),
        F.avg(F.abs(F.col("m") - F.col("d"))).alias("delta_mae"),
        F.avg(F.when(F.col("m") <= K.MAJOR_DROP, F.col("e"))).alias("major_drop_mae"),
        F.avg(F.when(F.col("m") <= K.SEVERE_DROP, F.col("e"))).alias("severe_drop_mae"),
        F.try_divide(hit, F.sum(flag(said))).alias("high_risk_precision"),
        F.try_divide(hit, F.sum(flag(risk))).alias("high_risk_recall"),
        F.min("p").alias("predicted_min"), F.max("p").alias("predicted_max"),
        F.stddev_pop(F.col("a") - F.col("p")).alias("residual_std"))


def threshold_metrics(df: DataFrame, label: str, prob: str, thresholds: Sequence[float]) -> DataFrame:
    """Precision, recall and F1 per threshold; rows are combined before they fan out."""
    bins = df.groupBy(F.col(label).alias("_y"), F.col(prob).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    tagged = bins.select("_y", "_p", "_c", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    said, real = F.col("_p") >= F.col("threshold"), F.col("_y") == 1
    total = lambda c: F.sum(F.when(c, F.col("_c")).otherwise(0))
    counted = tagged.groupBy("threshold").agg(
        total(said & real).alias("tp"), total(said).alias("predicted_alerts"), total(real).alias("actual_events"))
    precision = F.coalesce(F.try_divide("tp", "predicted_alerts"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", "actual_events"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return counted.select("threshold", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
                          "predicted_alerts", "actual_events")


def eval_classifier(df: DataFrame, label: str, prob: str, threshold: float) -> DataFrame:
    """Metrics at ``threshold`` plus ROC-AUC and average precision (NULL for one class).

    Both curves are running totals over the distinct probabilities, highest first, counted
    slice by slice: only the totals of the (at most 100,001) slices meet in one task.
    """
    curve = df.groupBy(F.col(prob).alias("_p")).agg(F.sum(flag(F.col(label) == 1)).alias("_pos"),
                                                    F.sum(flag(F.col(label) == 0)).alias("_neg"))
    curve = curve.withColumn(BLOCK, -F.floor(F.col("_p") * 100_000)).withColumn("_all", F.lit(0))
    upto = W.partitionBy("_all", BLOCK).orderBy(F.col("_p").desc()).rowsBetween(W.unboundedPreceding, 0)
    curve = carry(curve, ["_all"], "_p", sums={"_tp0": F.col("_pos"), "_fp0": F.col("_neg")})
    curve = curve.withColumns({"_tp": F.col("_tp0") + F.sum("_pos").over(upto),
                               "_fp": F.col("_fp0") + F.sum("_neg").over(upto)})
    # trapezoids under the ROC steps; precision weighted by the recall each step adds
    area = F.sum(F.col("_neg") * (F.col("_tp") - F.col("_pos") / 2.0))
    gain = F.sum(F.col("_pos") * F.col("_tp") / (F.col("_tp") + F.col("_fp")))
    pos, neg = F.sum("_pos"), F.sum("_neg")
    both = (pos > 0) & (neg > 0)
    areas = curve.agg(F.struct(F.when(both, area / (pos * neg)).alias("roc_auc"),
                               F.when(both, gain / pos).alias("pr_auc")).alias("a"))
    return threshold_metrics(df, label, prob, [threshold]).withColumn("_a", areas.scalar()).select(
        "*", "_a.roc_auc", "_a.pr_auc").drop("_a")


# --- training ---------------------------------------------------------------------------
@dataclass
class DeltaModel:
    model: boosting.Boosted
    features: list[str]
    medians: DataFrame
    keys: list[str]
    residual_std: float
    metrics: dict = field(default_factory=dict)
    n_rows: dict = field(default_factory=dict)
    drop_model: object | None = None
    drop_threshold: float | None = None


def _ready(df: DataFrame, medians: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    filled = impute_median(df, medians, keys, features)
    # a site where a feature never had a value in training has no median either
    known = set(features)
    filled = filled.select(*[F.expr(f"coalesce(double(`{c}`), 0D) AS `{c}`") if c in known else F.col(f"`{c}`") for c in filled.columns])
    return filled.withColumn("_x", array_to_vector(doubles(features)))


def drop_weight(delta: str = TARGET) -> Column:
    """Sample weight growing with the observed drop."""
    rule = F.lit(1.0)
    for limit, weight in K.DROP_WEIGHTS:
        rule = F.when(F.col(delta) <= limit, F.lit(weight)).otherwise(rule)
    return rule


def top_features(importances: Sequence[float], features: Sequence[str], n: int) -> list[str]:
    """The ``n`` most important features; ties keep list order (driver-side, one vector)."""
    order = sorted(range(len(features)), key=lambda i: -importances[i])
    return [features[i] for i in order[:n]]


def fit_delta(frame: DataFrame, features: Sequence[str], keys: Sequence[str],
              counts: Sequence[int] = tuple(K.FEATURE_COUNTS), rounds: int = 2000, rate: float = 0.02, patience: int = 100,
              rank_depth: int = 4, depth: int = 3, weight: Column | None = None,
              min_rows: int = K.MIN_TRAINING_ROWS, seed: int = 42, rank_share: float = 0.7, share: float = 0.8,
              l1: float = 1.0, l2: float = 10.0, least: float = 8.0, sample: float = 0.8) -> DeltaModel:
    """Rank features with a wide model, refit on each top-N, keep the best validation MAE.

    Splits are chronological per key and medians come from training rows only. A model keeps the trees up to
    its least validation error and stops after ``patience`` rounds without a lower one. All feature counts are
    fitted in the same passes. ``rank_share`` and ``share``: features each tree may use, in the ranking and in
    the final model; ``sample``: training rows each tree uses; ``least``: weight a leaf needs.
    """
    keep = list(dict.fromkeys([*keys, HOUR, "overall_site_health", "target_health_6h", TARGET, *features]))
    # the wide frame is derived once; everything below reads the materialised rows, and only their times are put in order
    usable = usable_rows(frame.select(*dict.fromkeys([*keep, *K.REQUIRED_FEATURES]))).select(*keep)
    usable = durable_checkpoint(usable.withColumn("_row", F.monotonically_increasing_id()))
    labels = chrono_split(usable.select(*keys, HOUR, "_row"), keys, HOUR).select("_row", "split")
    split = durable_checkpoint(usable.join(labels, "_row").drop("_row"))
    n = split.count()
    if n < min_rows:
        raise ValueError(f"too little history to train on: {n} usable rows, {min_rows} needed")
    train = split.filter("split = 'train'")
    features = drop_all_null(train, features)
    medians = feature_medians(train, keys, features).persist()
    rows = split.withColumn("_current", F.col("overall_site_health"))
    rows = _ready(rows, medians, keys, features).select(
        vector_to_array("_x").alias("_x"), "split", "_current", "target_health_6h", TARGET,
        (weight if weight is not None else F.lit(1.0)).alias("_w")).persist()
    try:
        def grow(*specs: boosting.Spec) -> list[tuple[boosting.Boosted, boosting.Report]]:
            return boosting.fit(rows.filter("split <> 'test'"), "_x", TARGET, specs, F.col("split") == "validation", F.col("_w"))
        common = dict(rounds=rounds, rate=rate, patience=patience, rows=sample, least=least, l1=l1, l2=l2, seed=seed)
        sizes = list(dict.fromkeys(min(c, len(features)) for c in counts))
        if sizes == [len(features)]:   # nothing to choose
            chosen = {len(features): list(features)}
        else:
            wide = grow(boosting.Spec(range(len(features)), rank_depth, rank_share, **common))[0][0]
            chosen = {c: top_features(wide.importance, features, c) for c in sizes}
        fits = dict(zip(sizes, grow(*[boosting.Spec([features.index(f) for f in chosen[c]], depth, share, **common) for c in sizes]), strict=True))
        by_count = {c: report.validation_mae[report.best_round] if report.validation_mae else float("nan") for c, (_, report) in fits.items()}
        best = min(sizes, key=lambda c: by_count[c])
        model = narrowed(fits[best][0], [features.index(f) for f in chosen[best]])
        at = F.transform(F.array(*[F.lit(features.index(f)) for f in chosen[best]]), lambda i: F.get("_x", i))
        done = rows.filter("split = 'test'").withColumn("prediction", model.column(at))
        test = eval_delta(done, "_current", "target_health_6h", "prediction").first().asDict()
        persistence = eval_delta(rows.filter("split = 'test'"), "_current", "target_health_6h",
                                 F.lit(0.0)).first().asDict()
        n_rows = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
        served = durable_checkpoint(medians.select(*keys, *chosen[best]))
        return DeltaModel(model, list(chosen[best]), served, list(keys), test["residual_std"] or 1.0, {
            "selected": test, "persistence": persistence, "validation_mae_by_count": by_count,
            "trees_by_count": {c: report.best_round for c, (_, report) in fits.items()},
            "rounds_by_count": {c: report.rounds for c, (_, report) in fits.items()},
            "mae_improvement": persistence["mae"] - test["mae"]}, n_rows)
    finally:
        rows.unpersist()
        medians.unpersist()


def narrowed(model: boosting.Boosted, columns: Sequence[int]) -> boosting.Boosted:
    """The same trees over the chosen columns alone, in their order."""
    place = {c: i for i, c in enumerate(columns)}
    trees = [boosting.Tree([place[f] if f >= 0 else -1 for f in t.feature], t.threshold, t.left, t.right, t.value) for t in model.trees]
    return boosting.Boosted(model.base, trees, [model.importance[c] for c in columns])


def fit_weighted(frame: DataFrame, model: DeltaModel, weight: Column | None = None, **options) -> tuple[DeltaModel, dict]:
    """The selected features fitted again under sample weights, and both test reports side by side."""
    weighted = fit_delta(frame, model.features, model.keys, counts=(len(model.features),),
                         weight=drop_weight() if weight is None else weight, **options)
    return weighted, {"plain": model.metrics["selected"], "weighted": weighted.metrics["selected"],
                      "persistence": model.metrics["persistence"]}


def fit_drop(frame: DataFrame, model: DeltaModel, trees: int = 500, depth: int = 8, seed: int = 42):
    """Major-drop classifier on the selected features with a validation-chosen threshold.

    Returns ``(classifier, threshold, test metrics)``. Training rows of a single class teach nothing: the classifier is then
    ``None``, every row has the chance 0 or 1 that the class says, and the metrics carry a ``status``. Where the
    validation rows tell no thresholds apart, as where there are none, it is the smallest.
    """
    keep = list(dict.fromkeys([*model.keys, HOUR, "major_drop_6h", *model.features]))
    rows = frame.select(*dict.fromkeys([*keep, *K.REQUIRED_FEATURES])).na.drop(
        subset=[*K.REQUIRED_FEATURES, "major_drop_6h"])
    rows = chrono_split(rows.select(*keep), model.keys, HOUR)
    ready = _ready(rows, model.medians, model.keys, model.features).select(
        "_x", "split", F.col("major_drop_6h").cast("double").alias("_y")).persist()
    try:
        train = ready.filter("split = 'train'")
        by_class = {r["_y"]: r["count"] for r in train.groupBy("_y").count().collect()}
        fitted = None
        if len(by_class) < 2:
            chance = ready.withColumn("_p", F.lit(1.0 if 1.0 in by_class else 0.0))
        else:
            total = sum(by_class.values())
            balance = F.when(F.col("_y") == 1, total / (2.0 * by_class[1.0])).otherwise(total / (2.0 * by_class[0.0]))
            forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_b", numTrees=trees, maxDepth=depth,
                                            minInstancesPerNode=5, featureSubsetStrategy="sqrt", seed=seed)
            fitted = forest.fit(train.withColumn("_b", balance))
            chance = fitted.transform(ready).withColumn("_p", vector_to_array("probability")[1])
        best = threshold_metrics(chance.filter("split = 'validation'"), "_y", "_p", K.DROP_THRESHOLDS).orderBy(
            F.col("f1").desc(), F.col("recall").desc(), "threshold").first()
        threshold = best["threshold"] if best else min(K.DROP_THRESHOLDS)
        test = eval_classifier(chance.filter("split = 'test'"), "_y", "_p", threshold).first()
        report = test.asDict() if test else {}
        if fitted is None:
            report["status"] = "not trained: a single class in the history"
        return fitted, threshold, report
    finally:
        ready.unpersist()


# --- prediction -------------------------------------------------------------------------
def predict_next(hourly: DataFrame, model: DeltaModel) -> DataFrame:
    """Per key: predicted change and health 6 h after the last row, and drop probability.

    Only the rows the longest look-back needs are kept before features are derived.
    """
    recent = tail(hourly, model.keys, HOUR, max(K.HEALTH_LAGS) + max(K.HEALTH_WINDOWS) + 24)
    frame, _ = model_frame(recent, model.keys, required_sources(model.features))
    last = tail(frame.select(*dict.fromkeys([*model.keys, HOUR, "overall_site_health", *model.features])),
                model.keys, HOUR, 1)
    out = _ready(last, model.medians, model.keys, model.features)
    out = out.withColumn("predicted_delta", model.model.column(vector_to_array("_x")))
    health = clip(F.col("overall_site_health") + F.col("predicted_delta"), 0.0, 100.0)
    cols = [*model.keys, HOUR, "predicted_delta", health.alias("predicted_health")]
    if model.drop_model is not None:
        out = model.drop_model.transform(out)
        cols.append(vector_to_array("probability")[1].alias("drop_probability"))
    return out.select(*cols)


_KINDS = re.compile(r"^(?P<src>.+)_(?P<kind>lag|change|rate|rollmean|rollstd|rollmin|rollmax|rollrange|slope|accel)"
                    r"_(?P<n>\d+)h$")
_HEALTH_STATS = re.compile(r"^health_(?P<kind>mean|std|min)_(?P<n>\d+)h$")


def feature_plan(features: Sequence[str]) -> list[tuple[str, str, int]]:
    """How to derive each feature of the newest row: ``(kind, source, n)``."""
    plan = []
    for name in features:
        stats, traj = _HEALTH_STATS.match(name), _KINDS.match(name)
        if stats:
            plan.append(("roll" + stats["kind"], "overall_site_health", int(stats["n"])))
        elif traj:
            src = traj["src"]
            plan.append((traj["kind"], "overall_site_health" if src == "overall_health" else src, int(traj["n"])))
        elif name in STREAKS:
            falling = name.endswith("_consecutive_decline_hours")
            src = "overall_site_health" if name == GLOBAL_STREAK else name.rsplit("_consecutive_", 1)[0]
            plan.append(("fall" if falling else "rise", src, 0))
        else:
            plan.append(("now", name, 0))
    return plan


def plan_columns(plan: Sequence[tuple[str, str, int]]) -> list[str]:
    """Hourly columns a feature plan reads."""
    cross = {*K.SUBSYSTEM_RISK, *K.SUBSYSTEM_HEALTH, "energy_anomaly_burden", "battery_anomaly_burden"}
    out: set[str] = {"overall_site_health"}
    for kind, src, _ in plan:
        if kind == "now" and src in CROSS:
            out |= cross
        elif src not in CALENDAR:
            out.add(src)
    return sorted(out)


def _newest(kind: str, x: np.ndarray, n: int) -> float:
    """One trajectory feature of the last value of ``x`` (row semantics, NaN when short)."""
    back = lambda k: x[-1 - k] if len(x) > k else np.nan
    if kind in ("fall", "rise"):
        steps = np.diff(x)[::-1]
        hit = steps < 0 if kind == "fall" else steps > 0
        return float(len(hit) if hit.all() else np.argmin(hit))
    if kind == "lag":
        return back(n)
    if kind == "change":
        return x[-1] - back(n)
    if kind == "rate":
        return (x[-1] - back(n)) / n
    if kind == "accel":
        return x[-1] - 2 * back(n) + back(2 * n)
    w = x[-n:]
    if len(w) < n or np.isnan(w).any():
        return np.nan
    if kind == "slope":
        t = np.arange(n) - (n - 1) / 2
        return float((t * (w - w.mean())).sum() / (t * t).sum())
    return float({"rollmean": np.mean, "rollmin": np.min, "rollmax": np.max, "rollrange": np.ptp,
                  "rollstd": lambda v: np.std(v, ddof=1)}[kind](w))


def _now(name: str, cols: Mapping[str, np.ndarray], at: pd.Timestamp) -> float:
    v = lambda c: cols[c][-1]
    if name in CALENDAR:
        day, hour = at.dayofweek, at.hour
        return {"hour_sin": np.sin(2 * np.pi * hour / 24), "hour_cos": np.cos(2 * np.pi * hour / 24),
                "day_of_week_sin": np.sin(2 * np.pi * day / 7), "day_of_week_cos": np.cos(2 * np.pi * day / 7),
                "is_weekend": float(day >= 5), "month": float(at.month)}[name]
    if name in CROSS:
        e, n, b = (v(c) for c in K.SUBSYSTEM_RISK)
        h = np.array([v(c) for c in K.SUBSYSTEM_HEALTH])
        return {"interaction_energy_battery_risk": n * b, "interaction_environmental_energy_risk": e * n,
                "interaction_environmental_battery_risk": e * b,
                "interaction_energy_battery_anomaly_burden": v("energy_anomaly_burden") * v("battery_anomaly_burden"),
                "max_subsystem_risk": np.nanmax([e, n, b]), "min_subsystem_health": np.nanmin(h),
                "subsystem_health_spread": np.nanmax(h) - np.nanmin(h),
                "subsystems_below_80": float((h < 80).sum()), "subsystems_below_60": float((h < 60).sum())}[name]
    return v(name)


def forecast_recursive(hourly: DataFrame, model: DeltaModel, hours: int, step: int = 6,
                       damping: float = K.DAMPING, advance_pm: Mapping[str, float] | None = None) -> DataFrame:
    """Damped recursive unroll per key, keys in parallel on executors.

    A task sees one key's last ~360 hourly rows (never its whole history) and emits
    ``hours / step`` points.  Health, its trend and volatility, the calendar and the
    maintenance risks (``advance_pm``: column -> interval days) evolve; all else is held.
    """
    keys, plan, trees = model.keys, feature_plan(model.features), model.model
    sigma, steps = float(model.residual_std or 1.0), max(1, -(-hours // step))
    pm = {f"{d}_pm_risk": float(days) for d, (_, days) in K.PM_DEFAULTS.items()} if advance_pm is None else dict(advance_pm)
    held = [c for c in plan_columns(plan) if c in hourly.columns]
    look_back = max(K.HEALTH_LAGS) + max(K.HEALTH_WINDOWS) + 24
    names = {f"_m_{i}": f for i, f in enumerate(model.features)}
    recent = tail(hourly.select(*dict.fromkeys([*keys, HOUR, *held])), keys, HOUR, look_back)
    known = model.medians.select(*keys, *[F.col(f).alias(m) for m, f in names.items()])
    recent = recent.join(known, list(keys), "left")
    health, trend, vol = "overall_site_health", "overall_site_health_trend_24h", "overall_site_health_volatility_24h"

    def unroll(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(HOUR)
        cols = {c: pdf[c].to_numpy(dtype=float) for c in held}
        fallback = np.nan_to_num(pdf[list(names)].iloc[0].to_numpy(dtype=float))
        at, out = pdf[HOUR].iloc[-1], []
        for i in range(1, steps + 1):
            x = np.array([_now(src, cols, at) if kind == "now" else _newest(kind, cols[src], n)
                          for kind, src, n in plan], dtype=float)
            x = np.where(np.isfinite(x), x, fallback)
            delta = float(trees.predict(x[None])[0]) * damping ** (i - 1)
            value = float(np.clip(cols[health][-1] + delta, 0.0, 100.0))
            at, band = at + pd.Timedelta(hours=step), sigma * np.sqrt(i)
            out.append((at, value, max(0.0, value - band), min(100.0, value + band)))
            for c in cols:
                cols[c] = np.append(cols[c], cols[c][-1])
            cols[health][-1] = value
            for c, days in pm.items():
                if c in cols:
                    cols[c][-1] = min(1.0, cols[c][-1] + step / 24.0 / days)
            series = cols[health]
            if trend in cols:
                cols[trend] = series - np.concatenate([np.full(min(24, len(series)), np.nan), series[:-24]])[:len(series)]
            if vol in cols:
                cols[vol] = pd.Series(series).rolling(24, min_periods=6).std().to_numpy()
        done = pd.DataFrame(out, columns=["timestamp", "value", "lower", "upper"])
        for k in reversed(keys):
            done.insert(0, k, pdf[k].iloc[0])
        return done
    types = dict(hourly.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "timestamp timestamp_ntz",
                        "value double", "lower double", "upper double"])
    return recent.groupBy(*keys).applyInPandas(unroll, schema)


def persistence_trajectory(hourly: DataFrame, keys: Sequence[str], hours: int, residual_std: float | Column,
                           step: int = 6) -> DataFrame:
    """The model-free baseline: the last value held, bands widening with the square root."""
    sigma = residual_std if isinstance(residual_std, Column) else F.lit(float(residual_std))
    last = hourly.groupBy(*keys).agg(F.max_by(F.struct(HOUR, "overall_site_health"), HOUR).alias("_l"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(max(1, -(-hours // step))))).alias("_k")
    rows = last.select(*keys, "_l", steps)
    value, band = F.col("_l.overall_site_health"), sigma * F.sqrt(F.col("_k").cast("double"))
    at = F.col(f"_l.{HOUR}") + F.make_dt_interval(hours=F.col("_k") * step)
    return rows.select(*keys, at.alias("timestamp"), value.alias("value"),
                       F.greatest(F.lit(0.0), value - band).alias("lower"),
                       F.least(F.lit(100.0), value + band).alias("upper"))


def forecast_points(hourly: DataFrame, trajectory: DataFrame, keys: Sequence[str],
                    horizons: Mapping[str, tuple[int, int, int]] = K.HORIZONS) -> DataFrame:
    """History and forecast of every horizon, on its display grid.

    One trajectory as long as the longest horizon serves all: shorter ones are its prefixes.
    """
    plan = F.explode(F.array(*[F.struct(F.lit(n).alias("horizon"), F.lit(h).alias("hours"),
                                        F.lit(s).alias("step"), F.lit(c).alias("points"))
                               for n, (h, s, c) in horizons.items()])).alias("_h")
    group = [*keys, "horizon"]
    rows = hourly.select(*keys, HOUR, "overall_site_health", plan).select(
        *keys, HOUR, "overall_site_health", "_h.*")
    past = resample_end(rows, [*group, "step", "points"], HOUR, "overall_site_health",
                        F.col("step"), F.col("points")).select(
        *group, "timestamp", "value", F.col("value").alias("lower"), F.col("value").alias("upper"),
        F.lit(False).alias("is_forecast"))
    last = hourly.groupBy(*keys).agg(
        F.max_by(F.struct(HOUR, "overall_site_health"), HOUR).alias("_l")).select(*keys, "_l", plan)
    value = F.col("_l.overall_site_health")
    anchor = last.select(*keys, "_h.*", F.col(f"_l.{HOUR}").alias("timestamp"), value.alias("value"),
                         value.alias("lower"), value.alias("upper"))
    ends = anchor.select(*group, (F.col("timestamp") + F.make_dt_interval(hours="hours")).alias("_end"))
    ahead = trajectory.join(ends, list(keys)).filter(F.col("timestamp") <= F.col("_end"))
    ahead = regrid(anchor, ahead, group, "step").withColumn("is_forecast", F.lit(True))
    return past.unionByName(ahead).select(
        *group, "timestamp", *[present(F.col(c), 2).alias(c) for c in ("value", "lower", "upper")],
        "is_forecast")


# --- storage ------------------------------------------------------------------------------
def save_model(model: DeltaModel, path: str, **stamps: str) -> None:
    """The trees, medians and classifier plus one metadata row (features, sizes, metrics, versions)."""
    spark = model.medians.sparkSession
    spark.createDataFrame([(model.model.as_json(),)], "trees string").coalesce(1).write.mode("overwrite").parquet(f"{path}/regressor")
    model.medians.write.mode("overwrite").parquet(f"{path}/medians")
    if model.drop_model is not None:
        model.drop_model.write().overwrite().save(f"{path}/classifier")
    meta = {"features": model.features, "keys": model.keys, "residual_std": model.residual_std,
            "metrics": model.metrics, "n_rows": model.n_rows, "drop_threshold": model.drop_threshold,
            "has_classifier": model.drop_model is not None, "score_version": K.SCORE_VERSION,
            "weight_version": K.WEIGHT_VERSION, **stamps}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load_model(spark, path: str) -> DeltaModel:
    meta = json.loads(spark.read.parquet(f"{path}/metadata").first()["meta"])
    drop = RandomForestClassificationModel.load(f"{path}/classifier") if meta["has_classifier"] else None
    trees = spark.read.parquet(f"{path}/regressor").first()["trees"]
    return DeltaModel(boosting.Boosted.from_json(trees), meta["features"],
                      spark.read.parquet(f"{path}/medians"), meta["keys"], meta["residual_std"], meta["metrics"],
                      meta["n_rows"], drop, meta["drop_threshold"])
