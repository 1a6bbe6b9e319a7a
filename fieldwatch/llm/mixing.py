"""Mixing sources to target weights by capped water-filling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, free_names, or_empty, share_of_hash
from .ordered import slice_of, with_starts

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2


def water_fill(sources: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET,
               max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``.

    Weights repeat over the sources by code point, null last. Clamping a source at its cap and
    sharing its excess by weight until none is above ends at one water level: sources fill up in the
    order of cap over weight, and what the full ones leave is shared by the weight of the rest. The
    windows see one row per source, a catalogue that does not grow with the documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    fill = W.orderBy("_full_at", F.col("source").asc_nulls_last())
    before, rest = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = (sources.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
              .withColumn("_full_at", F.col("_cap") / F.col("_weight")))
    # the level that this source and those after it would reach; it falls from the first source that
    # stays below its cap, so the highest level of such sources is the water level
    level = ((F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / F.sum("_weight").over(rest))
    ranked = ranked.withColumn("_level", level)
    water = F.max(F.when(F.col("_full_at") > F.col("_level"), F.col("_level"))).over(everything)
    return ranked.withColumn("_water", water).select(
        "source", "source_size",
        F.when(F.col("_water").isNull() | (F.col("_full_at") <= F.col("_water")), F.col("_cap"))
        .otherwise(F.col("_weight") * F.col("_water")).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS,
                seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, dict]:
    """All columns of ``docs`` and, under the returned names, ``size, source_size, target, copies``.

    A document's size is its number of words, 0 for null. Every document is repeated
    ``floor(target / source_size)`` times; the rest of the target goes to documents in seeded order,
    whole ones, for as long as the middle of a document lies before it, so that a source misses its
    target by half a document at most. A source without words has target 0. Rows of the same id keep
    an order by size; equal rows are interchangeable. An empty table gives no rows.
    """
    names = ["size", "source_size", "target", "copies", "_key", "_place", "_part", "_start", "_before"]
    n = dict(zip(names, free_names(docs, *names), strict=True))
    source = F.col(f"`{source_col}`").cast("string")
    rows = docs.withColumns({
        n["size"]: F.regexp_count(or_empty(text_col), F.lit(WORD)).cast("bigint"),
        n["_key"]: F.coalesce(F.concat(F.lit("s"), source), F.lit("n")),
        n["_place"]: share_of_hash(F.col(f"`{id_col}`"), seed)}).withColumn(n["_part"], slice_of(F.col(n["_place"])))
    slices = with_starts(rows.select(F.col(n["_key"]).alias("key"), F.col(n["_part"]).alias("part"), F.col(n["size"]).alias("w")),
                         ["key"], "part", {"w": F.col("w")})
    totals = slices.groupBy("key").agg(F.max("w_total").alias("source_size")).select(
        F.when(F.col("key") != "n", F.substring("key", 2, 2**30)).alias("source"), "source_size")
    filled = water_fill(totals, weights, budget, max_epochs).select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("key"), "source_size", "target")
    slices = slices.join(filled, "key").select(
        F.col("key").alias(n["_key"]), F.col("part").alias(n["_part"]), F.col("w_start").alias(n["_start"]),
        F.col("source_size").alias(n["source_size"]), F.col("target").alias(n["target"]))
    earlier = (W.partitionBy(n["_key"], n["_part"]).orderBy(n["_place"], F.col(f"`{id_col}`"), n["size"])
               .rowsBetween(W.unboundedPreceding, -1))
    mixed = rows.join(slices, [n["_key"], n["_part"]]).withColumn(
        n["_before"], F.col(n["_start"]) + F.coalesce(F.sum(n["size"]).over(earlier), F.lit(0)))
    target, total = F.col(n["target"]), F.col(n["source_size"])
    whole = F.when(total > 0, F.floor(target / total)).otherwise(0).cast("bigint")
    more = 2 * F.col(n["_before"]) + F.col(n["size"]) < 2 * (target - whole * total)
    mixed = mixed.withColumn(n["copies"], (whole + more.cast("bigint")))
    outputs = ["size", "source_size", "target", "copies"]
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns], *[n[o] for o in outputs]), {o: n[o] for o in outputs}


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every row as often as the mix takes it, with the columns of ``docs``."""
    mixed, n = mix_sources(docs, **options)
    (turn,) = free_names(mixed, "_turn")
    taken = mixed.filter(F.col(n["copies"]) > 0)
    return taken.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n["copies"])))).select(
        *[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('29:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][1 + CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INTEGER)]::DOUBLE AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS full_at,
         (1.5::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
water AS (SELECT max(level) AS water FROM levels WHERE full_at > level),
filled AS (
  SELECT source, source_size,
         CASE WHEN water IS NULL OR full_at <= water THEN cap ELSE weight * water END AS target
  FROM levels, water),
placed AS (
  SELECT d.*, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
  FROM sized d JOIN filled f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN 2 * before + size < 2 * (target - whole * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed"""
