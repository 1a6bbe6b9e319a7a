"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, verified Hamming distance.

A fingerprint is cut into ``BLOCKS`` blocks. Two that differ in at most ``DISTANCE`` bits agree on at
least ``BLOCKS - DISTANCE`` of them, so each fingerprint is listed under every choice of that many
blocks, and only fingerprints listed under a common key are compared. Equal fingerprints count once.

A key may be shared by a dense group. Its pairs are never formed: every member is first compared with
one member of its list (as many comparisons as members), which links most of a dense group; lists
whose members then hang together are done, and in the others only members outside the list's main
component are compared with the rest.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable_checkpoint

WIDTH = 4        # words in a shingle
DISTANCE = 4     # bits that linked fingerprints may differ in
BLOCKS = 7       # 3 of 7 blocks make 35 keys of 27 bits; with 8 blocks, 70 keys of 32 bits
SEED = 42


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64-bit fingerprint of one whole text, 0 where it has no words."""
    words = text.encode().lower().split() if text else []   # bytes methods: A-Z only, [\x20\x09-\x0D] only
    if not words:
        return 0
    grams = list(zip(*(words[k:] for k in range(width)), strict=False)) or [tuple(words)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(b" ".join(g), SEED) for g in grams]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):   # whole text, in bounded memory
        ones += np.unpackbits(hashes[at:at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint_column(text: Column, width: int = WIDTH) -> Column:
    @F.arrow_udf("bigint")
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), width) for t in texts], np.uint64).view(np.int64))
    return fingerprints(text.cast("string"))


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """One mask for each choice of ``blocks - distance`` blocks, as signed 64-bit numbers."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) - (1 << 64 if sum(chosen) >= 1 << 63 else 0) for chosen in combinations(parts, blocks - distance)]


def close(a: str, b: str, distance: int = DISTANCE) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def block_lists(prints: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE) -> DataFrame:
    """``key, fp`` for every fingerprint under every choice of blocks that at least two share."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(block_masks(blocks, distance))])
    listed = prints.select("fp", F.explode(keys).alias("key"))
    shared = listed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("first")).filter("n > 1").drop("n")
    return listed.join(shared, "key")


def components(links: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """``node, root`` for every node of ``a, b`` links; the root is the component's smallest node.

    Alternates large-star and small-star steps, each a join with one smallest neighbour per node, until
    nothing changes: rounds grow with the logarithm of the longest chain. Neighbour lists are never
    gathered. Each round is written to the checkpoint folder. ``rows_per_task``: tasks that a round begins with
    take that many links, where partitions hold few.
    """
    def dealt(edges: DataFrame, n: int) -> DataFrame:
        return edges if rows_per_task is None else edges.coalesce(max(1, -(-n // rows_per_task)))
    edges = durable_checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                               .filter("u <> v").distinct())
    state = _state(edges)
    edges = dealt(edges, state[0])
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = (edges.join(least, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        edges = durable_checkpoint(edges)
        before, state = state, _state(edges)
        edges = dealt(edges, state[0])
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def fingerprint_components(prints: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE) -> DataFrame:
    """``fp, root`` for distinct fingerprints that have a link; others are left out."""
    lists = durable_checkpoint(block_lists(prints, blocks, distance))
    stars = lists.filter(F.col("fp") != F.col("first")).filter(close("fp", "first", distance)).select(
        F.col("fp").alias("a"), F.col("first").alias("b")).distinct()
    near = durable_checkpoint(components(stars))
    placed = lists.select("key", "fp").join(near.withColumnRenamed("node", "fp"), "fp", "left").select(
        "key", "fp", F.coalesce("root", "fp").alias("root"))
    # members of each component in each list; lists of one component have nothing left to compare
    sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    open_lists = durable_checkpoint(placed.join(mixed.select("key", F.col("most.root").alias("main")), "key"))
    few = open_lists.filter("root <> main").select("key", F.col("fp").alias("a"), F.col("root").alias("ra"))
    every = open_lists.select("key", F.col("fp").alias("b"), F.col("root").alias("rb"))
    verified = few.join(every, "key").filter((F.col("ra") != F.col("rb")) & close("a", "b", distance)).select(
        F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    joined = durable_checkpoint(components(verified))
    nodes = near.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select(
        F.col("node").alias("fp"), F.coalesce("top", "root").alias("root"))
    alone = joined.join(near.select("node"), "node", "left_anti").select(F.col("node").alias("fp"), "root")
    return nodes.union(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS,
                    distance: int = DISTANCE, width: int = WIDTH) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Fingerprints link at ``distance`` or fewer differing bits; a component's id is the smallest
    ``doc_id`` reachable. Null, empty and blank texts have fingerprint zero, which links like any other.
    A null id names a component only where nothing else is in it. Repeated rows are alike. An empty
    table gives no rows. Other columns are not read.
    """
    rows = durable_checkpoint(docs.select(F.col(f"`{id_col}`").alias("doc_id"), fingerprint_column(F.col(f"`{text_col}`"), width).alias("fp")))
    prints = durable_checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = fingerprint_components(prints.select("fp"), blocks, distance)
    rooted = durable_checkpoint(prints.join(linked, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS,
                         distance: int = DISTANCE, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that stay: of every component the document with the smallest id.

    Rows that share that id stay together; rows without an id stay.
    """
    gone = (near_duplicates(docs, id_col, text_col, blocks, distance, width).filter(F.col("doc_id") != F.col("component_id"))
            .select(F.col("doc_id").alias("_gone_id")).distinct())
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("_gone_id"), "left_anti")
