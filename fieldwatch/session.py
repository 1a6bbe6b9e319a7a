"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import gc
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.checkpoint.compress": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",   # a checkpoint goes with the last reference to it
}


def build_session(app: str = "fieldwatch", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply what the operators rely on: naive UTC time, the package on the executors."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="fieldwatch-package-")) / "fieldwatch-package"
    context.addPyFile(shutil.make_archive(str(base), "zip", root.parent, root.name))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    That is the context's checkpoint folder, else ``spark.checkpoint.dir``. A temporary folder serves
    only a local master, whose executors run on this machine; anywhere else its absence is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="fieldwatch-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt_checkpoint(df: DataFrame) -> DataFrame:
    """``durable_checkpoint`` of rows that were dealt by key: joins by that key know where they are and do not move them again.

    Adaptive plans do not say how their rows are dealt, so this one is none; ``df`` should do little more than deal stored rows.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    was = conf.get(name)
    conf.set(name, "false")
    try:
        return durable_checkpoint(df.select("*"))   # planned under this setting
    finally:
        conf.set(name, was)


def let_go(spark: SparkSession) -> None:
    """Have the files of checkpoints and shuffles deleted that nothing refers to: Spark's cleaner only learns of them when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
