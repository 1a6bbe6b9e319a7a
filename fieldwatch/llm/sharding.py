"""Sharding by proportional stratified interleaving.

Rows are ranked in seeded random order inside their source, the rank becomes a fraction of the
source, and all rows are ordered by that fraction: every stretch of the order then holds the
sources in the proportions of the whole. Cutting it into equal stretches gives the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable_checkpoint, or_empty, share_of_hash
from .ordered import slice_of, with_starts

STRETCHES = 4096   # parts of the interleaved order that are sorted on their own


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    Law ``rows``: shard counts differ by one at most, and slots run gapless from 0. A null text has
    size 1 and the checksum of no bytes; a null source is a source of its own. Rows with the same id
    keep an order by size and checksum; wholly equal rows are interchangeable. ``grown_shard`` is null
    for this law. An empty table gives no rows. Other columns are not read.
    """
    text = or_empty(text_col).cast("binary")
    source = F.col(f"`{source_col}`").cast("string")
    # a null source and a source with an empty name stay apart
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("source"),
                       (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("place", share_of_hash(F.col("doc_id"), seed)).withColumn("part", slice_of(F.col("place")))
    starts = with_starts(rows, ["source"], "part", {"n": F.lit(1)})
    inside = W.partitionBy("source", "part").orderBy("place", "doc_id", "size", "text_crc32")
    ranked = (rows.join(starts, ["source", "part"])
              .withColumn("rank", F.col("n_start") + F.row_number().over(inside))
              .withColumn("share", (F.col("rank") - 0.5) / F.col("n_total")))
    ranked = durable_checkpoint(ranked.select(
        "doc_id", "source", "size", "text_crc32", "place", "share",
        F.least(F.floor(F.col("share") * STRETCHES), F.lit(STRETCHES - 1)).cast("int").alias("stretch"),
        F.lit(0).alias("all")))
    starts = with_starts(ranked, ["all"], "stretch", {"n": F.lit(1)}).drop("all")
    inside = W.partitionBy("stretch").orderBy("share", "source", "place", "doc_id", "size", "text_crc32")
    place = F.col("n_start") + F.row_number().over(inside) - 1
    cut = ranked.join(starts, "stretch").withColumn("g", place).withColumn("shard", F.expr(f"g * {shards} div n_total"))
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                      (F.col("g") - F.expr(f"(shard * n_total + {shards - 1}) div {shards}")).cast("bigint").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))
