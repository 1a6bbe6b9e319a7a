"""Near-duplicates by exact Jaccard similarity of word shingles, at or above 4/5.

Shingles are put in one order, rare ones first. Two sets that are similar enough share a shingle among
the first ``n - ceil(0.8 n) + 1`` of each, so every document is listed under these only, and no similar
pair is missed; with one shingle more it shares two. Pairs of a list first meet as bitmaps of their shingles, one to two bits a shingle, which
bound what two sets can share from above; the few pairs that are left are confirmed on the whole sets
of 64-bit shingle hashes, which are made for the documents of such pairs only.

Pairs of a dense list are not formed: its members are compared with a few drawn ones, and only what
then lies outside the list's main component is compared with the rest, where two lists name the pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable_checkpoint, or_empty
from .simhash import SEED, components

WIDTH = 5          # words in a shingle
CELLS = 1 << 18    # of the frequency table, whose size does not grow with the corpus
DRAWN = 8          # members of a list that all others are compared with
LINKS = 50_000     # narrow rows that one task takes
CROWDED = 4.0      # cells with that many times the mean number of shingles are too common to gather a key's list


#: Odd multipliers and shifts of a common 64-bit finaliser (fixed values).
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of one whole text, sorted; a shorter text is one shingle."""
    words = text.encode().lower().split() if text else []   # A-Z only, [\x20\x09-\x0D] only
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(w, SEED) for w in words]), ">u8").astype(np.uint64)
    width = min(width, len(h))
    n = len(h) - width + 1
    out = h[:n]
    for k in range(1, width):
        out = out * STEP + h[k:n + k]
    for shift, factor in MIX:
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return np.unique(out)


def stored(df: DataFrame, rows: int = LINKS) -> DataFrame:
    """Written to the checkpoint folder, and read back by tasks of some ``rows`` rows rather than by many of few."""
    kept = durable_checkpoint(df)
    return kept.coalesce(max(1, -(-kept.count() // rows)))


def cell_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 18)).astype(np.int64)


def tree_sum(parts: DataFrame, size: int, add) -> np.ndarray:
    """``size`` numbers of every partition (one binary value each), put together by ``add`` in a tree."""
    return parts.rdd.map(lambda r: np.frombuffer(r[0], np.int64)).treeAggregate(np.zeros(size, np.int64), add, add)


def cell_counts(docs: DataFrame, text_col: str, width: int = WIDTH) -> np.ndarray:
    """The shingles of all documents by cell: a table of fixed size."""
    def counted(batches):
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(counts, cell_of(shingles(text.as_py(), width)), 1)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], ["counts"])
    parts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(counted, "counts binary")
    return tree_sum(parts, CELLS, np.add)


def frequency_levels(counts: np.ndarray) -> np.ndarray:
    """How common the shingles of each cell are, as one small number a cell.

    Any order of the shingles finds every pair; this one keeps lists short.
    """
    return np.minimum(np.round(4 * np.log2(1 + counts / (1 + counts.mean()))), 255).astype(np.uint8)


def bitmap(s: np.ndarray) -> bytes:
    """One bit of a power of two set for every shingle; at least 64 and at least as many bits as shingles."""
    size = max(64, 1 << max(len(s) - 1, 0).bit_length())
    bits = np.zeros(size, bool)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmap that the same shingles have with fewer bits."""
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def sharing_bound(x: bytes, nx: int, y: bytes, ny: int) -> int:
    """At least as many shingles as the two sets share: every bit that only one has set is a shingle of its own."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    a, b = folded(a, size), folded(b, size)
    return min(nx - int(np.bitwise_count(a & ~b).sum()), ny - int(np.bitwise_count(b & ~a).sum()))


def listing_column(text: Column, counts: np.ndarray, width: int = WIDTH) -> Column:
    """``n`` shingles, their bitmap and the rarest of them with whether its cell is crowded; texts without words share one key."""
    levels, crowded = frequency_levels(counts), counts > CROWDED * (1 + counts.mean())

    @F.arrow_udf("struct<n:int,bits:binary,keys:array<bigint>,crowded:array<boolean>>")
    def listings(texts: pa.Array) -> pa.Array:
        sizes, bits, keys, common = [], [], [], []
        for t in texts:
            s = shingles(t.as_py(), width)
            n = len(s)
            first = s[np.lexsort((s, levels[cell_of(s)]))][:n - (4 * n + 4) // 5 + 2]
            sizes.append(n)
            bits.append(bitmap(s))
            keys.append(first.view(np.int64) if n else np.zeros(1, np.int64))
            common.append(crowded[cell_of(first)] if n else np.ones(1, bool))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                                           pa.array(common, pa.list_(pa.bool_()))], ["n", "bits", "keys", "crowded"])
    return listings(text)


def similar(a: str, b: str) -> Column:
    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            out.append(5 * shared >= 4 * (len(x) + len(y) - shared))
        return pa.array(out, pa.bool_())
    return alike(F.col(a), F.col(b))


def may_share(a: str, na: str, b: str, nb: str) -> Column:
    """Whether the bitmaps leave room for the similarity."""
    @F.arrow_udf("boolean")
    def possible(a: pa.Array, na: pa.Array, b: pa.Array, nb: pa.Array) -> pa.Array:
        return pa.array([9 * sharing_bound(x.as_py(), n, y.as_py(), m) >= 4 * (n + m)
                         for x, n, y, m in zip(a, na.to_pylist(), b, nb.to_pylist())], pa.bool_())
    return possible(F.col(a), F.col(na), F.col(b), F.col(nb))


def may_be(na: str, at_a: str, nb: str, at_b: str, before: int = 0) -> Column:
    """Whether sizes, and places of a shingle that is shared with ``before`` others ahead of it, leave room for the similarity."""
    a, b = F.col(na), F.col(nb)
    shared = F.least(a - F.col(at_a), b - F.col(at_b)) + before
    return (5 * F.least(a, b) >= 4 * F.greatest(a, b)) & (9 * shared >= 4 * (a + b))


class Texts:
    """The documents' texts, read again for the sets of those that need them."""

    def __init__(self, docs: DataFrame, text_col: str, width: int):
        self.texts, self.width = docs.select(digest_of(text_col).alias("digest"), or_empty(text_col).alias("text")), width

    def sets(self, digests: DataFrame) -> DataFrame:
        """``digest, set`` of the distinct ``digest`` rows.

        A bit table of the digests (two megabytes at most, however many there are) spares most other texts
        the hashing and the shuffle; the join decides.
        """
        digests = stored(digests.distinct())
        words = 1 << min(max(digests.count() // 4, 1).bit_length(), 18)   # 16 bits a digest, up to 2 MB

        def marked(batches):
            table = np.zeros(words, np.int64)
            for batch in batches:
                at = places(batch.column(0), words)
                np.bitwise_or.at(table, at >> 6, np.int64(1) << (at & 63))
            yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["bits"])
        table = tree_sum(digests.select("digest").mapInArrow(marked, "bits binary"), words, np.bitwise_or)

        width = self.width

        def made(batches):
            for batch in batches:
                at = places(batch.column(0), words)
                wanted = batch.filter(pa.array((table[at >> 6] >> (at & 63)) & 1 == 1))
                yield pa.RecordBatch.from_arrays([wanted.column(0), pa.array(
                    [shingles(t.as_py(), width).tobytes() for t in wanted.column(1)], pa.binary())], ["digest", "set"])
        few = self.texts.mapInArrow(made, "digest binary, set binary")
        return durable_checkpoint(few.dropDuplicates(["digest"]).join(digests, "digest", "left_semi"))


def places(digests: pa.Array, words: int) -> np.ndarray:
    """Bit numbers of 16-byte digests in a table of that many 64-bit words."""
    joined = b"".join(d.as_py()[:8] for d in digests)
    return (np.frombuffer(joined, "<u8") & np.uint64(64 * words - 1)).astype(np.int64)


def confirmed(pairs: DataFrame, marks: DataFrame, texts: Texts) -> DataFrame:
    """The similar ones of ``a, b`` pairs. ``marks``: ``node, n, bits, digest``."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda x: marks.select(*[F.col(c).alias(f"{c}_{x}" if c != "node" else x) for c in ("node", "n", "bits", "digest")])
    close = pairs.join(side("a"), "a").join(side("b"), "b").filter(may_share("bits_a", "n_a", "bits_b", "n_b"))
    close = stored(close.select("a", "b", "digest_a", "digest_b"))
    sets = texts.sets(close.select(F.explode(F.array("digest_a", "digest_b")).alias("digest")))
    # equal texts need no sets, and pairs of equal texts are one
    kinds = close.filter("digest_a <> digest_b").select(F.least("digest_a", "digest_b").alias("x"), F.greatest("digest_a", "digest_b").alias("y")).distinct()
    alike = kinds.join(sets.select(F.col("digest").alias("x"), F.col("set").alias("sx")), "x").join(
        sets.select(F.col("digest").alias("y"), F.col("set").alias("sy")), "y").filter(similar("sx", "sy")).select("x", "y")
    alike = stored(alike)
    different = close.select("a", "b", F.least("digest_a", "digest_b").alias("x"), F.greatest("digest_a", "digest_b").alias("y"))
    return stored(different.filter("x = y").select("a", "b").union(
        different.filter("x <> y").join(alike, ["x", "y"]).select("a", "b")))


def digest_of(text_col: str) -> Column:
    """A text's 128-bit name; null and empty texts are alike."""
    return F.unhex(F.md5(or_empty(text_col).cast("binary")))


def similar_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``id, node, root`` of the rows that have a link; every row is a node of its own.

    The key rows are dealt out once. A key of a cell that is not crowded holds a bounded share of them (``CROWDED``
    cells of ``CELLS``), so a window tells whether it is shared; keys of crowded cells are taken as shared.
    """
    counts = cell_counts(docs, text_col, width)
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), digest_of(text_col).alias("digest"))
    marks = named.select("id", "digest", listing_column(F.col("text"), counts, width).alias("f"))
    marks = durable_checkpoint(marks.select("id", "digest", "f.*", F.monotonically_increasing_id().alias("node")))
    listed = marks.select("node", "n", F.posexplode(F.arrays_zip("keys", "crowded")).alias("at", "k")).select(
        "node", "n", "at", F.col("k.keys").alias("key"), F.col("k.crowded").alias("crowded"))
    key = W.partitionBy("key")
    shared = (listed.filter("not crowded").withColumn("low", F.min("node").over(key)).withColumn("high", F.max("node").over(key))
              .filter("low < high"))
    lists = durable_checkpoint(shared.select("key", "node", "n", "at").union(listed.filter("crowded").select("key", "node", "n", "at")))
    texts = Texts(docs, text_col, width)
    member = [F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("at_a")]
    links = confirmed(_with_drawn(lists.select("key", *member), lists, range(1)), marks, texts)
    placed = _open(lists, components(links, LINKS))
    # a short list bounds its pairs by itself
    dense = placed.filter(F.col("size") > DRAWN)
    links = links.union(confirmed(_with_drawn(dense.filter("root <> main").select("key", *member), dense, range(1, DRAWN)), marks, texts))
    placed = _open(placed.select("key", "node", "n", "at"), components(links, LINKS))
    few = placed.filter("root <> main").select("key", *member, F.col("root").alias("ra"), "main")
    every = placed.select("key", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("at").alias("at_b"))
    # roots differ, so every list of the two holds one of them among its few: a similar pair is met under its first two shared keys
    once = (F.col("rb") == F.col("main")) | (F.col("a") < F.col("b"))
    met = few.join(every, "key").filter((F.col("ra") != F.col("rb")) & once & may_be("na", "at_a", "nb", "at_b", 1)).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "key", (F.col("na") + F.col("nb") < 3).alias("tiny"))
    twice = met.groupBy("a", "b").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.max("tiny").alias("tiny")).filter("tiny or low < high")
    near = components(links.union(confirmed(twice.select("a", "b"), marks, texts)), LINKS)
    return marks.select("id", "node").join(near, "node")


def _with_drawn(members: DataFrame, lists: DataFrame, rounds: range) -> DataFrame:
    """Pairs of the members and those drawn from their list; lists of the same members draw alike, so that pairs repeat."""
    drawn = lists.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.array(*[
        F.min(F.struct(F.xxhash64("node", F.lit(r)).alias("h"), "node", "n", "at")) for r in rounds]).alias("c")).filter("m > 1")
    # stored, so that both sides of the join are plain shuffles and a hot key can be split there
    centres = stored(drawn.select("key", F.explode("c").alias("c")).select(
        "key", F.col("c.node").alias("b"), F.col("c.n").alias("nb"), F.col("c.at").alias("at_b")).distinct())
    return members.join(centres, "key").filter((F.col("a") != F.col("b")) & may_be("na", "at_a", "nb", "at_b")).select("a", "b")


def _open(lists: DataFrame, near: DataFrame) -> DataFrame:
    """The lists of more than one component, with every member's ``root``, the list's ``main`` one and its ``size``."""
    placed = durable_checkpoint(lists.join(near, "node", "left").withColumn("root", F.coalesce("root", "node")))
    main = stored(
        placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("key")
        .agg(F.max(F.struct("m", "root")).alias("most"), F.count(F.lit(1)).alias("roots"), F.sum("m").alias("size")).filter("roots > 1")
        .select("key", F.col("most.root").alias("main"), "size"))
    return durable_checkpoint(placed.join(main, "key"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that stay: of every component the document with the smallest id.

    Rows that share that id stay together; rows without an id stay. Texts without words are alike; null and
    empty texts are such. Repeated rows are equal texts. An empty table gives no rows. Other columns are not read.
    """
    rooted = stored(similar_rows(docs, id_col, text_col, width).select("id", "root"))
    least = stored(rooted.groupBy("root").agg(F.min("id").alias("least")))
    gone = rooted.join(least, "root").filter("id <> least").select(F.col("id").alias("_gone_id")).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("_gone_id"), "left_anti")
