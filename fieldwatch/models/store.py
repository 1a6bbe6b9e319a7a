"""Stored models: the state model with its scaler, anomalous states and training thresholds, and the forest.

Both are small and independent of the data, so each is one row of JSON, or one row per tree, in a
Parquet table that every executor can read.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

from .hmm import HmmModel, Params, Scaler
from .iforest import Forest

TREE = ("feature", "threshold", "left", "right", "path")


def _write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def _read_meta(spark: SparkSession, path: str, kind: str) -> dict:
    meta = json.loads(spark.read.parquet(f"{path}/metadata").first()["meta"])
    if meta["kind"] != kind:
        raise ValueError(f"{path} holds a {meta['kind']}, not a {kind}")
    return meta


def save_state_model(spark: SparkSession, model: HmmModel, path: str, **stamps: str) -> None:
    p = model.params
    _write_meta(spark, path, {
        "kind": "state model", "start": p.start.tolist(), "trans": p.trans.tolist(), "mean": p.mean.tolist(), "var": p.var.tolist(),
        "scaler_mean": list(model.scaler.mean), "scaler_std": list(model.scaler.std), "cols": list(model.cols),
        "log_likelihood": model.log_likelihood, "converged": bool(model.converged), "anomalous": [int(s) for s in model.anomalous],
        "thresholds": model.thresholds, **stamps})


def load_state_model(spark: SparkSession, path: str) -> HmmModel:
    m = _read_meta(spark, path, "state model")
    params = Params(*(np.array(m[k], dtype=float) for k in ("start", "trans", "mean", "var")))
    return HmmModel(params, Scaler(m["scaler_mean"], m["scaler_std"]), m["cols"], m["log_likelihood"], m["converged"],
                    m["anomalous"], m["thresholds"])


def save_forest(spark: SparkSession, forest: Forest, path: str, **stamps: str) -> None:
    rows = [(i, *(np.asarray(x).tolist() for x in tree)) for i, tree in enumerate(forest.trees)]
    kinds = "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, path array<double>"
    spark.createDataFrame(rows, kinds).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    _write_meta(spark, path, {"kind": "forest", "cols": list(forest.cols), "scaler_mean": list(forest.scaler.mean),
                              "scaler_std": list(forest.scaler.std), "sample": int(forest.sample), "offset": float(forest.offset), **stamps})


def load_forest(spark: SparkSession, path: str) -> Forest:
    m = _read_meta(spark, path, "forest")
    trees = [tuple(np.asarray(r[c]) for c in TREE) for r in spark.read.parquet(f"{path}/trees").orderBy("tree").collect()]
    return Forest(m["cols"], Scaler(m["scaler_mean"], m["scaler_std"]), trees, m["sample"], m["offset"])
