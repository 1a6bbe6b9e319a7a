"""Vector code compression: every part of a vector becomes the number of its nearest codebook entry.

Nearest entries are found in a geometric near-neighbour access tree over the codebook. A node picks
some entries as split points, gives each of the others to the nearest split point, and keeps, for
every split point and every child, the smallest and largest distance from the one to the other's
entries. A query measures its distances to the split points and drops every child whose range lies
farther from its own distance than the best entry found so far. Only strictly worse children go, with
room for rounding, and squared distances of integers are compared exactly, so ties go to the lowest
index as in a full search.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable_checkpoint

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
SPLITS = 8            # split points of a node
LEAF = 16             # entries up to which a node is searched in full
ROWS = 8192           # vectors searched together
SLACK = 1e-9          # relative room for rounding when children are dropped


def number_type(bound: float, dims: int) -> type:
    """A number type in which squared distances of ``dims`` integers up to ``bound`` are exact."""
    most = 4.0 * dims * (bound + 1) ** 2
    return np.float64 if most < 2.0 ** 53 else np.int64 if most < 2.0 ** 62 else object


def exactly(floats: np.ndarray, kind: type) -> np.ndarray:
    """Integers held as floats, in the given type."""
    if kind is not object:
        return floats.astype(kind)
    out = np.empty(floats.shape, object)
    out.ravel()[:] = [int(x) for x in floats.ravel().tolist()]
    return out


def squared(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``q`` from every row of ``e``; exact in the types of ``number_type``."""
    return (q * q).sum(axis=1)[:, None] - 2 * (q @ e.T) + (e * e).sum(axis=1)[None, :]


def lengths(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


@dataclass
class Node:
    points: np.ndarray                 # numbers of the split points, or of all entries of a leaf
    children: list[Node | None]        # by split point; empty for a leaf
    low: np.ndarray                    # smallest and largest distance, by split point and child
    high: np.ndarray


class EntryTree:
    """The tree over one codebook; entries are rows of exact numbers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        # of equal entries only the first can be nearest
        _, first = np.unique(entries.astype(str) if entries.dtype == object else entries, axis=0, return_index=True)
        self.root = self._node(np.sort(first))

    def _node(self, numbers: np.ndarray) -> Node:
        if len(numbers) <= LEAF:
            return Node(numbers, [], np.empty(0), np.empty(0))
        # split points far from each other: each next one is the farthest from those there are
        apart = squared(self.entries[numbers], self.entries[numbers])
        chosen = [0]
        while len(chosen) < SPLITS:
            chosen.append(int(apart[:, chosen].min(axis=1).argmax()))
        owner = apart[:, chosen].argmin(axis=1)
        owner[chosen] = np.arange(SPLITS)
        away = lengths(apart[chosen])
        mine = [np.flatnonzero(owner == j) for j in range(SPLITS)]
        low = np.array([[away[i, m].min() for m in mine] for i in range(SPLITS)])
        high = np.array([[away[i, m].max() for m in mine] for i in range(SPLITS)])
        rest = [numbers[m[m != c]] for m, c in zip(mine, chosen, strict=True)]
        return Node(numbers[chosen], [self._node(r) if len(r) else None for r in rest], low, high)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of every query's nearest entry, the lowest of equal ones, and the squared distance."""
        best = squared(queries, self.entries[:1])[:, 0]
        number = np.zeros(len(queries), np.int64)
        self._search(self.root, queries, np.arange(len(queries)), best, number)
        return number, best

    def _search(self, node: Node, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, number: np.ndarray) -> None:
        far = squared(queries[rows], self.entries[node.points])
        least = far.min(axis=1)
        # among equal distances the lowest entry number; points are not in the order of their numbers
        at = np.where(far == least[:, None], node.points[None, :], np.iinfo(np.int64).max).min(axis=1)
        better = ((least < best[rows]) | ((least == best[rows]) & (at < number[rows]))).astype(bool)
        best[rows[better]], number[rows[better]] = least[better], at[better]
        if not node.children:
            return
        away, own = lengths(far), far.argmin(axis=1)
        for visit_own in (True, False):    # the child of the nearest split point first, which finds a small distance
            for j, child in enumerate(node.children):
                if child is None:
                    continue
                radius = lengths(best[rows])
                room = SLACK * (away + node.high[:, j] + radius[:, None])
                gap = np.maximum(away - node.high[:, j], node.low[:, j] - away)
                go = ((own == j) == visit_own) & ~(gap > radius[:, None] + room).any(axis=1)
                if go.any():
                    self._search(child, queries, rows[go], best, number)


def kept_vectors(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector and all its components are there and finite, also when scaled."""
    return vectors.filter(F.forall(F.col(f"`{vector_col}`"), lambda x: F.abs(x.cast("double") * SCALE) < F.lit(float("inf"))))


def integers(column: pa.Array, dims: int) -> np.ndarray:
    """Scaled components, rounded down, as floats that are integers; short vectors are filled up with zeros."""
    values = np.asarray(column.flatten().cast(pa.float64()))
    sizes = np.diff(np.asarray(column.offsets)).astype(np.int64)
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < sizes[:, None]] = np.floor(values * SCALE)
    return out


def blocks(batches, dims: int):
    """``row numbers, integer vectors`` for some ``ROWS`` vectors at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield _block(held, dims)
            held, n = [], 0
    if n:
        yield _block(held, dims)


def _block(batches: list[pa.RecordBatch], dims: int) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks()
    column = table.column("v").combine_chunks()
    return table, integers(column, dims)


class Codec:
    """The codebooks of all parts, with a tree over each."""

    def __init__(self, codebooks: np.ndarray, bound: float):
        self.kind = number_type(bound, codebooks.shape[2])
        self.codebooks = codebooks
        self.trees = [EntryTree(exactly(book, self.kind)) for book in codebooks]

    def assign(self, floats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(rows, parts)`` entry numbers and squared distances."""
        own = exactly(floats, self.kind).reshape(len(floats), len(self.trees), -1)
        found = [tree.nearest(own[:, p]) for p, tree in enumerate(self.trees)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def partial_sums(rows: DataFrame, codec: Codec, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors each entry has, and the sums of their parts, over all rows; partitions are summed up in a tree."""
    shape = codec.codebooks.shape

    def summed(batches):
        counts = np.zeros(shape[:2], object)
        sums = np.zeros(shape, object)
        for _, floats in blocks(batches, dims):
            codes, _ = codec.assign(floats)
            # whole numbers: exact in 64 bits for a block where squares of them are
            own = exactly(floats, np.int64 if codec.kind is np.float64 else codec.kind).reshape(len(floats), shape[0], shape[2])
            for p in range(shape[0]):
                counts[p] += np.bincount(codes[:, p], minlength=shape[1]).astype(object)
                order = np.argsort(codes[:, p], kind="stable")
                used, first = np.unique(codes[order, p], return_index=True)
                sums[p, used] += np.add.reduceat(own[order, p], first, axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, [*counts.ravel(), *sums.ravel()]))])], ["sums"])

    def added(a: str, b: str) -> str:
        if not a or not b:
            return a or b
        return " ".join([str(x + y) for x, y in zip(map(int, a.split()), map(int, b.split()), strict=True)])
    text = rows.select("v").mapInArrow(summed, "sums string").rdd.map(lambda r: r[0]).treeAggregate("", added, added, depth=3)
    flat = np.array([int(x) for x in text.split()] or [0] * (shape[0] * shape[1] * (1 + shape[2])), object)
    n = shape[0] * shape[1]
    return flat[:n].reshape(shape[:2]), flat[n:].reshape(shape)


def first_codebooks(rows: DataFrame, order: list, entries: int, parts: int, dims: int) -> np.ndarray:
    """The parts of the first vectors; at most ``entries`` rows reach the driver."""
    first = [np.floor(np.array(r[0], np.float64) * SCALE) for r in rows.orderBy(*order).limit(entries).select("v").collect()]
    flat = np.zeros((len(first), dims))
    for k, v in enumerate(first):
        flat[k, :len(v)] = v
    return exactly(flat.reshape(len(first), parts, dims // parts).transpose(1, 0, 2), object)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, codes, error`` for every kept vector, and the codebooks ``(parts, entries, positions)``.

    Vectors that are null or hold a null or non-finite component (also where scaling makes one) are
    dropped. All others are taken as long as the longest, rounded up to a multiple of ``parts``; missing
    components are zero. The first codebook entries are the vectors of the smallest ids (null ids last;
    rows of one id in the order of their components); with fewer vectors than ``entries`` there are as many
    entries as vectors. Repeated rows are alike. A table without kept vectors gives no rows. ``error`` is
    held at 2**63 - 1 where it is larger. ``codes`` has one byte an entry number, so ``entries`` is 256 at most.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code byte names at most 256 entries")
    columns = [F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"),
               F.col(f"`{vector_col}`").cast("array<double>").alias("v")]
    rows = kept_vectors(vectors, vector_col).select(*columns)
    schema = rows.schema
    # one pass for the size of everything; the maximum of an empty vector is null
    longest, bound = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if longest is None:
        return rows.select("vec_id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("bigint").alias("error")), np.zeros((parts, 0, 0), object)
    dims, bound = max(-(-longest // parts), 1) * parts, (bound or 0.0) * SCALE + 1
    books = first_codebooks(rows, [F.col("vec_id").asc_nulls_last(), "v"], entries, parts, dims)
    for _ in range(rounds):
        counts, sums = partial_sums(rows, Codec(books, bound), dims)
        used = counts > 0
        books = books.copy()
        books[used] = sums[used] // counts[used][:, None]
    codec = Codec(books, bound)

    def coded(batches):
        for table, floats in blocks(batches, dims):
            codes, squares = codec.assign(floats)
            total = [min(int(e), 2 ** 63 - 1) for e in exactly_added(squares)]
            yield from pa.table([table.column("vec_id"), table.column("label"), pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()),
                                 pa.array(total, pa.int64())], names=["vec_id", "label", "codes", "error"]).to_batches()
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    out = rows.mapInArrow(coded, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes binary, error bigint")
    return out, books


def exactly_added(squares: np.ndarray) -> list:
    return squares.astype(np.int64 if squares.dtype == np.float64 else squares.dtype).astype(object).sum(axis=1).tolist()


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_table(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every kept vector.

    Errors are summed by label before a label's rows meet; the sums, one row a label, are joined back,
    and adaptive execution splits a label that holds many rows. Null labels count as one.
    """
    coded, books = compress(vectors, id_col, vector_col, label_col)
    coded = durable_checkpoint(coded.select("vec_id", F.col("label").isNull().alias("bare"), F.col("label").cast("string").alias("name"),
                                            F.lower(F.hex("codes")).alias("code"), "error").fillna("", ["name"]))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2 ** 63 - 1).cast("decimal(38,0)")).cast("bigint")
    sums = durable_checkpoint(coded.groupBy("bare", "name").agg(total.alias("label_error")))
    return coded.join(sums, ["bare", "name"]).select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """Full search in SQL; vectors of one length that the parts divide."""
    def assigned(k: int) -> str:
        return f"""near{k} as materialized (
    select x.r, x.part, arg_min(b.entry, [d, b.entry]) as entry, min(d) as d
    from pieces x join book{k} b on x.part = b.part,
         lateral (select list_sum([(x.v[i] - b.v[i]) * (x.v[i] - b.v[i]) for i in range(1, len(x.v) + 1)])::bigint as d)
    group by x.r, x.part)"""

    def replaced(k: int) -> str:
        return f"""means{k} as (
    select n.part, n.entry, i, floor_div_sum(sum(x.v[i]), count(*)) as c
    from near{k} n join pieces x on x.r = n.r and x.part = n.part, range(1, (select max(len(v)) from pieces) + 1) as p(i)
    group by n.part, n.entry, i
), book{k + 1} as materialized (
    select b.part, b.entry, coalesce(m.v, b.v) as v
    from book{k} b left join (select part, entry, list(c order by i) as v from means{k} group by part, entry) m
         on m.part = b.part and m.entry = b.entry)"""
    steps = ",\n".join(f"{assigned(k)},\n{replaced(k)}" for k in range(rounds))
    steps = steps.replace("floor_div_sum(sum(x.v[i]), count(*))",
                          "((sum(x.v[i]) - (((sum(x.v[i]) % count(*)) + count(*)) % count(*))) // count(*))::bigint")
    return f"""
with kept as materialized (
    select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label,
           [floor(x::double * {SCALE})::bigint for x in embedding] as v
    from embeddings
    where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), pieces as materialized (
    select r, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] as v from kept, range({parts}) as p(part)
), book0 as materialized (
    select part, r - 1 as entry, v from pieces where r <= {entries}
), {steps},
{assigned(rounds)},
codes as (
    select r, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from near{rounds} group by r
), digest as (
    select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as codebooks_sha256 from book{rounds}
)
select k.vec_id, c.code, c.error, (sum(c.error) over (partition by k.label))::bigint as label_error, digest.codebooks_sha256
from kept k join codes c on c.r = k.r, digest"""


ORACLE = oracle()
