"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable_checkpoint, prepare

WHITESPACE = " \t\n\u000b\f\r"   # the six characters of [\x20\x09-\x0D]
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 1000                # rows per Arrow batch; long texts make the default of 10,000 too heavy

__all__ = ["BATCH_ROWS", "WHITESPACE", "WORD", "durable_checkpoint", "free_names", "or_empty", "ready",
           "share_of_hash", "table", "without_whitespace"]


def ready(spark: SparkSession) -> SparkSession:
    """Session settings and package that the operators rely on."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def or_empty(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def without_whitespace(text: Column) -> Column:
    for c in WHITESPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted helper column names, lengthened until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def share_of_hash(key: Column, seed: int) -> Column:
    """32 hexadecimal digits that order rows at random, alike on every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
