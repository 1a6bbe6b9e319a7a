"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame functions only.

Every document is dealt to one of ``runs`` runs by a hash of its row. A run holds one entry per
digest: how many rows, and the smallest rank among them. The runs then meet in binomial rounds:
in each round ``fan`` neighbouring runs merge into one, digest by digest, keeping the smallest
rank, until one entry per digest is left. A group that holds a third of all rows is thus one entry
per run and round, never a list of rows; Spark spreads every round over ``(digest, run)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable_checkpoint, free_names, or_empty, without_whitespace

RUNS = 16
FAN = 4


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_code_points, digest, check``: SHA-256 and an independent hash of the text without white space.

    Both must agree for two rows to count as equal, so each level verifies what it merges.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), or_empty(text_col).alias("_text"))
    bare = texts.select("doc_id", F.char_length("_text").cast("bigint").alias("n_code_points"),
                        without_whitespace(F.col("_text")).alias("_bare"))
    return bare.select("doc_id", "n_code_points", F.sha2(F.col("_bare").cast("binary"), 256).alias("digest"),
                       F.xxhash64("_bare").alias("check"))


def merge_runs(entries: DataFrame, runs: int = RUNS, fan: int = FAN) -> DataFrame:
    """``digest, check, best, group_size`` from rows of ``digest, check, rank, uid``.

    ``rank`` is any orderable struct; its smallest value is kept at every level.
    """
    level = (entries.withColumn("run", F.pmod(F.xxhash64("uid"), F.lit(runs)).cast("int"))
             .groupBy("digest", "check", "run")
             .agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("group_size")))
    left = runs
    while left > 1:
        left = -(-left // fan)
        keys = ["digest", "check"] + (["run"] if left > 1 else [])
        level = (level.withColumn("run", F.floor(F.col("run") / fan).cast("int")).groupBy(*keys)
                 .agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size")))
    return level


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS,
                     fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without white space; null counts as empty. The longest original
    text stays, then the smallest id; a null id comes last. Of rows that repeat a document wholly,
    one is kept. An empty table gives no rows. Other columns are not read.
    """
    rows = durable_checkpoint(digest_table(docs, id_col, text_col)
                              .withColumn("uid", F.monotonically_increasing_id()))
    rank = F.struct((-F.col("n_code_points")).alias("longest"), F.col("doc_id").isNull().alias("no_id"),
                    F.col("doc_id").alias("id"), F.col("uid").alias("uid"))
    # stored, so that both sides of the join are plain shuffles and a hot digest can be split there
    groups = durable_checkpoint(merge_runs(rows.withColumn("rank", rank), runs, fan).select("digest", "check", "best", "group_size"))
    return rows.join(groups, ["digest", "check"]).select(
        "doc_id", F.col("best.id").alias("keep_id"), F.col("group_size").cast("bigint").alias("group_size"),
        (F.col("uid") == F.col("best.uid")).alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row of each group."""
    key, other = free_names(docs, "_row_key", "_kept_key")
    made = digest_table(docs, id_col, text_col)

    def row_key(c_id, length, digest):
        return F.concat_ws("|", F.coalesce(c_id.cast("string"), F.lit("null")), length.cast("string"), digest)
    bare = without_whitespace(or_empty(text_col))
    keyed = docs.withColumn(key, row_key(F.col(f"`{id_col}`"), F.char_length(or_empty(text_col)),
                                         F.sha2(bare.cast("binary"), 256)))
    rank = F.struct((-F.col("n_code_points")).alias("longest"), F.col("doc_id").isNull().alias("no_id"),
                    F.col("doc_id").alias("id"))
    entries = made.withColumns({"rank": rank, "uid": F.coalesce(F.col("doc_id"), F.lit(-1))})
    stay = merge_runs(entries).select(row_key(F.col("best.id"), -F.col("best.longest"), F.col("digest")).alias(other))
    return (keyed.join(stay, F.col(key) == F.col(other), "left_semi").dropDuplicates([key]).drop(key))


ORACLE = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS digest
  FROM documents),
ranked AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY digest) AS group_size
  FROM bare WINDOW w AS (PARTITION BY digest ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, digest AS text_sha256 FROM ranked"""
