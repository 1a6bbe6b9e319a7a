"""Isolation forest over event features (M6): trees grown and rows scored in parallel.

Each tree sees a bounded random sample drawn by hashing, so no task reads the whole table;
the finished forest (trees x at most 2 x sample nodes, independent of the data) is shipped
to the executors and scores rows batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.quantiles import quantile_columns
from .hmm import Scaler, fit_scaler


@dataclass
class Forest:
    cols: list[str]
    scaler: Scaler
    trees: list[tuple[np.ndarray, ...]]  # per tree: feature, threshold, left, right, path length
    sample: int
    offset: float


def mean_path(n: float) -> float:
    """Average depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[list, ...]:
    feature, threshold, left, right, path = [], [], [], [], []

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(feature)
        for column, blank in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (path, 0.0)):
            column.append(blank)
        spread = rows.max(0) > rows.min(0)
        if depth >= limit or len(rows) <= 1 or not spread.any():
            path[at] = depth + mean_path(len(rows))
            return at
        f = int(rng.choice(np.flatnonzero(spread)))
        cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        feature[at], threshold[at] = f, cut
        left[at] = add(rows[rows[:, f] <= cut], depth + 1)
        right[at] = add(rows[rows[:, f] > cut], depth + 1)
        return at
    add(x, 0)
    return feature, threshold, left, right, path


def outlier_score(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Minus the anomaly score (lower = more unusual), vectorised over the rows of a batch."""
    depth = np.zeros(len(x))
    for feature, threshold, left, right, path in forest.trees:
        node = np.zeros(len(x), dtype=int)
        while True:
            f = feature[node]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                break
            at = node[inner]
            node[inner] = np.where(x[inner, f[inner]] <= threshold[at], left[at], right[at])
        depth += path[node]
    return -np.power(2.0, -depth / len(forest.trees) / max(mean_path(forest.sample), 1e-12))


def _scaled(cols: Sequence[str], scaler: Scaler) -> list:
    return [((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - m) / s).alias(f"f{i}")
            for i, (c, m, s) in enumerate(zip(cols, scaler.mean, scaler.std))]


def fit_isolation(df: DataFrame, cols: Sequence[str] = tuple(K.EVENT_FEATURES), row_id: Sequence[str] = (),
                  trees: int = K.FOREST_TREES, contamination: float = K.FOREST_CONTAMINATION,
                  sample: int = K.FOREST_SAMPLE, seed: int = K.FOREST_SEED) -> Forest:
    """Grow the forest; ``row_id`` makes the sample independent of partitioning."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    scaler = fit_scaler(filled, cols)
    n = df.count()
    if n == 0:
        raise ValueError("no rows to fit on")
    names = [f"f{i}" for i in range(len(cols))]
    ident = list(row_id) or list(cols)
    draw = lambda *salt: F.xxhash64(*[F.col(c) for c in ident], *[F.lit(s) for s in salt])
    wanted = min(sample, n)
    # A tree takes the rows of the smallest draws, without replacement. Rows below a threshold go to the
    # shuffle only: on average `spare` times what a tree needs, so that it misses none.
    spare = 1.0 if wanted == n else 1.0 + 8.0 / np.sqrt(wanted) + 8.0 / wanted
    top = min(1.0, spare * wanted / n) * 2.0 ** 64 - 2.0 ** 63
    numbered = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(draw(seed), t).alias("_o")))
    drawn = F.filter(numbered, lambda d: d["_o"].cast("double") <= F.lit(top))
    rows = filled.select(F.explode(drawn).alias("_d"), *_scaled(cols, scaler)).select(F.col("_d.tree").alias("tree"), F.col("_d._o").alias("_o"), *names)
    limit = int(np.ceil(np.log2(max(wanted, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(["_o", *names])[names].to_numpy(dtype=float)[:wanted]
        if len(x) < wanted:
            raise RuntimeError(f"tree {t} drew {len(x)} of {wanted} rows")
        rng = np.random.default_rng([seed, t])
        return pd.DataFrame([(t, *grow(x, rng, limit))], columns=["tree", "feature", "threshold", "left", "right", "path"])
    grown = rows.groupBy("tree").applyInPandas(
        build, "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, path array<double>")
    nodes = [tuple(np.asarray(r[c]) for c in ("feature", "threshold", "left", "right", "path"))
             for r in grown.orderBy("tree").collect()]
    forest = Forest(list(cols), scaler, nodes, wanted, 0.0)
    raw = _raw_scores(df.select(*cols), forest)
    cut = quantile_columns(raw, [], "raw_score", {"q": contamination}).first()["q"]
    forest.offset = float(cut)
    return forest


def _raw_scores(df: DataFrame, forest: Forest) -> DataFrame:
    names = [f"f{i}" for i in range(len(forest.cols))]
    keep = df.columns
    shared = df.sparkSession.sparkContext.broadcast(forest)
    struct = F.struct(*[F.col(c) for c in keep]).alias("_row")
    staged = df.select(struct, *_scaled(forest.cols, forest.scaler))

    @F.pandas_udf("double")
    def score(*features: pd.Series) -> pd.Series:
        return pd.Series(outlier_score(shared.value, np.column_stack([f.to_numpy(dtype=float) for f in features])))
    return staged.select("_row.*", score(*names).alias("raw_score"))


def score_isolation(df: DataFrame, forest: Forest) -> DataFrame:
    """Adds ``score`` (below 0 = outlier) and ``is_anomaly``; other columns, such as the dominant category, stay."""
    scored = _raw_scores(df, forest)
    return scored.withColumn("score", F.col("raw_score") - F.lit(forest.offset)).withColumn(
        "is_anomaly", F.col("score") < 0).drop("raw_score")


def outlier_episodes(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Alarm outliers in the shape of episodes, so that they reach the served tables."""
    return scored.filter("is_anomaly").select(
        *keys, F.col("start_time").alias("start"), F.lit("high").alias("direction"),
        F.lit("alert").alias("severity"), F.col("total_alarms").cast("double").alias("peak_value"),
        F.greatest(F.col("duration_sec") / 60.0, F.lit(K.MIN_EPISODE_MINUTES)).alias("duration_min"))
