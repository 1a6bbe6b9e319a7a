"""Gradient-boosted regression trees over histograms of once-binned columns (M7, M8).

Every column is cut into at most ``bins`` bins once. A level of a tree is one pass over the binned
rows: tasks add up gradients by node, column and bin, the sums are put together in a tree, and the
driver, which only ever sees these sums, picks the splits. Several models (feature counts) grow in the
same passes. The pass for a tree's first level also scores the validation rows under the trees so far.

Gradients are whole numbers of a small unit, so sums do not depend on how rows are dealt out or in
which order tasks end: a refit gives the same trees on any cluster. Tasks hold no state between passes;
what the trees so far predict is recomputed from a snapshot, which itself comes from the stored rows.

Where all binned rows fit a task, a pass takes longer to start than to add up. Each model then grows in a
task of its own, from the same rows, draws and sums, to the same trees.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable_checkpoint

ROWS = 8192          # rows of a block
AT_ONCE = 512        # rows that all trees predict together
COLUMNS = 64         # columns whose histograms are counted at once
UNIT_BITS = 30       # the largest gradient is about two to this power of units
SNAPSHOT = 25        # rounds after which predictions so far are kept again
ALONE = 1 << 25      # bin numbers that a task holds to grow a model alone


@dataclass
class Tree:
    """Nodes by number, the root first. ``feature`` is -1 for a leaf; values up to ``threshold`` go left."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    bin: list[int] = field(default_factory=list)   # the threshold as a bin number, while training


@dataclass
class Boosted:
    base: float
    trees: list[Tree]
    importance: list[float]     # mean gain of a column's splits, shares of one

    @cached_property
    def nodes(self) -> tuple[np.ndarray, ...]:
        """The nodes of all trees one after another: roots, then feature, threshold, left, right and value."""
        sizes = [len(t.feature) for t in self.trees]
        starts = np.cumsum([0, *sizes])[:-1]
        joined = lambda name: np.array([v for t in self.trees for v in getattr(t, name)])
        shift = np.repeat(starts, sizes).astype(np.int64)
        return starts, joined("feature"), joined("threshold"), joined("left") + shift, joined("right") + shift, joined("value")

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Of every row of ``x``; all trees are walked together."""
        total = np.full(len(x), self.base)
        if not self.trees:
            return total
        roots, feature, threshold, left, right, value = self.nodes
        for k in range(0, len(x), AT_ONCE):
            part = x[k:k + AT_ONCE]
            rows, node = np.arange(len(part))[:, None], np.tile(roots, (len(part), 1))
            while (inner := feature[node] >= 0).any():
                low = part[rows, np.maximum(feature[node], 0)] <= threshold[node]
                node = np.where(inner, np.where(low, left[node], right[node]), node)
            total[k:k + AT_ONCE] += value[node].sum(axis=1)
        return total

    def column(self, x: Column) -> Column:
        """The prediction for an array column."""
        @F.arrow_udf("double")
        def predicted(rows: pa.Array) -> pa.Array:
            flat = np.asarray(rows.flatten().cast(pa.float64()))
            return pa.array(self.predict(flat.reshape(len(rows), -1)) if len(rows) else np.zeros(0))
        return predicted(x)

    def as_json(self) -> str:
        return json.dumps({"base": self.base, "importance": self.importance,
                           "trees": [[t.feature, t.threshold, t.left, t.right, t.value] for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        m = json.loads(text)
        return cls(m["base"], [Tree(*t) for t in m["trees"]], m["importance"])


@dataclass
class Spec:
    """One model to be grown. ``columns``: those it may use, by number."""

    columns: Sequence[int]
    depth: int = 3
    share: float = 0.8           # of the columns, drawn for each tree
    rounds: int = 2000
    rate: float = 0.02
    patience: int = 100          # rounds without a better validation error
    rows: float = 0.8            # share of training rows drawn for each tree
    least: float = 8.0           # weight a child needs
    l1: float = 1.0
    l2: float = 10.0
    seed: int = 42


@dataclass
class Report:
    best_round: int
    rounds: int
    validation_mae: list[float]    # after 0, 1, ... trees


class _Grown:
    """The driver's side of one model while it grows."""

    def __init__(self, spec: Spec, base: float):
        self.spec, self.base = spec, base
        self.trees: list[Tree] = []
        self.kept = 0                              # trees that the snapshot holds
        self.gain = np.zeros(max(spec.columns) + 1 if len(spec.columns) else 0)
        self.splits = np.zeros(len(self.gain))
        self.mae: list[float] = []
        self.best = 0
        self.done = False
        self.start()

    def start(self) -> None:
        s = self.spec
        draw = np.random.default_rng((s.seed, len(self.trees)))
        n = max(1, round(s.share * len(s.columns)))
        self.drawn = np.sort(draw.choice(np.asarray(s.columns), n, replace=False)) if n < len(s.columns) else np.asarray(s.columns)
        self.tree = Tree([-1], [0.0], [-1], [-1], [0.0], [0])
        self.front, self.level = [0], 0

    def view(self) -> dict:
        return {"recent": self.trees[self.kept:], "tree": self.tree, "front": self.front, "columns": self.drawn, "round": len(self.trees),
                "rows": self.spec.rows, "seed": self.spec.seed}


def cut(values: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(values) * np.maximum(np.abs(values) - alpha, 0.0)


def _walk(tree: Tree, codes: np.ndarray) -> np.ndarray:
    """The leaf of every row; ``codes`` by column."""
    feature, at, left, right = map(np.array, (tree.feature, tree.bin, tree.left, tree.right))
    rows, node = np.arange(codes.shape[1]), np.zeros(codes.shape[1], np.int64)
    while (inner := feature[node] >= 0).any():
        low = codes[np.maximum(feature[node], 0), rows] <= at[node]
        node = np.where(inner, np.where(low, left[node], right[node]), node)
    return node


def _added(margin: np.ndarray, trees: Sequence[Tree], codes: np.ndarray) -> np.ndarray:
    for t in trees:
        margin = margin + np.array(t.value)[_walk(t, codes)]
    return margin


def _drawn(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    return np.random.default_rng((seed, 1, tree, block)).random(n)


def _sums(codes: np.ndarray, columns: np.ndarray, at: np.ndarray, place: np.ndarray, front: int, gradient: np.ndarray, w: np.ndarray, bins: int) -> np.ndarray:
    """Gradients and weights of the rows ``at`` by ``(node, column, bin)``."""
    sums, base = np.zeros((2, front, len(columns), bins)), place * bins
    for k in range(0, len(columns), COLUMNS):
        part = codes[columns[k:k + COLUMNS]][:, at].astype(np.int64)
        cells = (part + base + np.arange(len(part))[:, None] * (front * bins)).ravel()
        for which, weight in enumerate((gradient, w)):
            counted = np.bincount(cells, np.tile(weight, len(part)), minlength=len(part) * front * bins)
            sums[which, :, k:k + len(part)] = counted.reshape(len(part), front, bins).transpose(1, 0, 2)
    return sums


def _histograms(block: tuple, views: dict[int, dict], bins: int, unit: float) -> dict[int, tuple]:
    """Sums of one block: per model ``(nodes, columns, bins)`` gradients and weights, and the validation error."""
    number, codes, y, w, held, margins = block
    out = {}
    for m, v in views.items():
        margin = _added(margins[m], v["recent"], codes)
        error = (0.0, 0.0)
        if v["front"] == [0]:
            error = (float(np.abs(y - margin)[held].sum()), float(held.sum()))
        node = _walk(v["tree"], codes)
        place = np.full(len(v["tree"].feature), -1)
        place[v["front"]] = np.arange(len(v["front"]))
        take = ~held & (place[node] >= 0)
        if v["rows"] < 1:
            take &= _drawn(v["seed"], v["round"], number, len(y)) < v["rows"]
        at = np.flatnonzero(take)
        gradient = np.rint((margin - y)[at] * w[at] / unit)
        sums = _sums(codes, v["columns"], at, place[node[at]], len(v["front"]), gradient, w[at], bins)
        out[m] = (sums[0], sums[1], np.array(error))   # whole gradients below 2**53 add up exactly as floats
    return out


def _merge(a: dict, b: dict) -> dict:
    return {m: tuple(x + y for x, y in zip(a[m], b[m], strict=True)) for m in a}


def _split(g: np.ndarray, h: np.ndarray, spec: Spec) -> tuple | None:
    """``(gain, column, bin, left gradient, left weight)`` of a node's best split; the first of equal ones."""
    gl, hl = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
    gt, ht = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
    score = lambda a, b: cut(a, spec.l1) ** 2 / (b + spec.l2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = score(gl, hl) + score(gt - gl, ht - hl) - score(gt, ht)
    gain = np.where((hl >= spec.least) & (ht - hl >= spec.least), gain, -np.inf)
    if not gain.size:
        return None
    k, at = np.unravel_index(int(gain.argmax()), gain.shape)
    return (gain[k, at], k, at, gl[k, at], hl[k, at]) if gain[k, at] > 1e-6 else None


def _grow(model: _Grown, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray]) -> None:
    """Split the open nodes by their sums, or close them; closes the tree when nothing is open."""
    spec, tree, opened = model.spec, model.tree, []
    leaf = lambda a, b: float(-spec.rate * cut(a, spec.l1) / (b + spec.l2)) if b + spec.l2 > 0 else 0.0
    depth = model.level + 1
    for node, gn, hn in zip(model.front, g, h, strict=True):
        best = _split(gn, hn, spec) if len(gn) else None
        if best is None:
            if node == 0 and len(gn):
                tree.value[0] = leaf(gn[0].sum(), hn[0].sum())
            continue
        gain, k, at, gl, hl = best
        column = int(model.drawn[k])
        model.gain[column] += gain
        model.splits[column] += 1
        tree.feature[node], tree.bin[node], tree.threshold[node] = column, int(at), float(edges[column][at])
        tree.left[node], tree.right[node] = len(tree.feature), len(tree.feature) + 1
        gt, ht = gn[0].sum(), hn[0].sum()
        for a, b in ((gl, hl), (gt - gl, ht - hl)):
            opened.append(len(tree.feature))
            for column_of, blank in ((tree.feature, -1), (tree.threshold, 0.0), (tree.left, -1), (tree.right, -1), (tree.value, leaf(a, b)), (tree.bin, 0)):
                column_of.append(blank)
    model.front = opened if depth < spec.depth else []
    model.level = depth
    if not model.front:
        model.trees.append(tree)


def bin_edges(rows: DataFrame, x: str, width: int, bins: int) -> list[np.ndarray]:
    """The upper bounds of each column's bins but the last: approximate quantiles of the training rows."""
    at = [k / bins for k in range(1, bins)]
    long = rows.select(F.posexplode(x).alias("c", "v"))
    found = long.groupBy("c").agg(F.percentile_approx("v", at, 10 * bins).alias("q"))
    out = [np.zeros(0)] * width
    for r in found.toLocalIterator():
        out[r["c"]] = np.unique(np.array(r["q"], float))
    return out


def binned_blocks(rows: DataFrame, x: str, y: str, weight: str, held: str, edges: list[np.ndarray]) -> DataFrame:
    """Blocks of rows as ``number, n, codes, y, w, held``: bin numbers by column, one byte each."""
    def work(batches):
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                yield packed(waiting)
                waiting, n = [], 0
        if n:
            yield packed(waiting)

    def packed(batches):
        t = pa.Table.from_batches(batches).combine_chunks()
        n = len(t)
        values = np.asarray(t.column(0).combine_chunks().flatten().cast(pa.float64())).reshape(n, len(edges))
        codes = np.stack([np.searchsorted(e, values[:, c]) for c, e in enumerate(edges)]).astype(np.uint8)
        real = [np.asarray(t.column(k).cast(pa.float64()).combine_chunks()).tobytes() for k in (1, 2)]
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([codes.tobytes()], pa.binary()), *[pa.array([b], pa.binary()) for b in real],
                                           pa.array([np.asarray(t.column(3).to_pylist(), bool).tobytes()], pa.binary())], ["n", "codes", "y", "w", "held"])
    packed_rows = rows.select(x, y, weight, held).mapInArrow(work, "n int, codes binary, y binary, w binary, held binary")
    return durable_checkpoint(packed_rows.withColumn("number", F.monotonically_increasing_id()))


def _grown_alone(blocks: list[tuple], spec: Spec, base: float, edges: list[np.ndarray], bins: int, unit: float) -> _Grown:
    """One model from all blocks, in this task."""
    blocks = sorted(blocks, key=lambda b: b[0])
    codes = np.concatenate([b[1] for b in blocks], axis=1)
    y, w, held = (np.concatenate([b[k] for b in blocks]) for k in (2, 3, 4))
    v, margin = _Grown(spec, base), np.full(len(y), base)
    while True:
        v.start()
        if _settled(v, np.array([np.abs(y - margin)[held].sum(), held.sum()], float)):
            v.done = True
            return v
        taken = ~held
        if spec.rows < 1:
            taken &= np.concatenate([_drawn(spec.seed, len(v.trees), b[0], len(b[2])) for b in blocks]) < spec.rows
        taken = np.flatnonzero(taken)
        mine, gradient, weight = codes[:, taken], np.rint((margin - y)[taken] * w[taken] / unit), w[taken]
        while v.front:
            node = _walk(v.tree, mine)
            place = np.full(len(v.tree.feature), -1)
            place[v.front] = np.arange(len(v.front))
            at = np.flatnonzero(place[node] >= 0)
            g, h = _sums(mine, v.drawn, at, place[node[at]], len(v.front), gradient[at], weight[at], bins)
            _grow(v, g * unit, h, edges)
        margin = _added(margin, v.trees[-1:], codes)


def fit(rows: DataFrame, x: str, y: str, specs: Sequence[Spec], held: Column, weight: Column | None = None,
        bins: int = 64, snapshot: int = SNAPSHOT, alone: int = ALONE) -> list[tuple[Boosted, Report]]:
    """Grow one model per spec: in shared passes, or each in its task where the table has at most ``alone`` bin numbers.

    ``x``: an array column without nulls, of one length; ``held``: the validation rows, which choose how many
    trees are kept (those up to the least mean absolute error; without such rows, all). Tree ``i`` of a
    model uses rows and columns drawn by its seed and ``i``. Without training rows this is an error.
    """
    if not 2 <= bins <= 256:
        raise ValueError("a bin number is one byte")
    rows = rows.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"),
                       (F.lit(1.0) if weight is None else weight).cast("double").alias("w"), F.coalesce(held, F.lit(False)).alias("held"))
    train = rows.filter("not held")
    facts = train.agg(F.max(F.size("x")).alias("width"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("base"),
                      F.max(F.abs("y")).alias("far"), F.max("w").alias("heavy")).first()
    if facts["width"] is None:
        raise ValueError("no training rows")
    width, base = facts["width"], float(facts["base"])
    unit = 2.0 ** (int(np.ceil(np.log2(max(facts["far"] * facts["heavy"], 1e-9)))) + 1 - UNIT_BITS)
    edges = bin_edges(train, "x", width, bins)
    stored = binned_blocks(rows, "x", "y", "w", "held", edges)
    models = {m: _Grown(s, base) for m, s in enumerate(specs)}
    blocks = stored.select("number", "n", "codes", "y", "w", "held").rdd.map(lambda r: (
        r["number"], np.frombuffer(r["codes"], np.uint8).reshape(width, r["n"]), np.frombuffer(r["y"]), np.frombuffer(r["w"]), np.frombuffer(r["held"], bool)))

    if specs and stored.agg(F.sum("n")).first()[0] * width <= alone:
        own = blocks.flatMap(lambda b: [(m, b) for m in range(len(specs))]).groupByKey(len(specs), int)
        grown = dict(own.map(lambda found: (found[0], _grown_alone(list(found[1]), specs[found[0]], base, edges, bins, unit))).collect())
        return [_finished(grown[m]) for m in models]

    def with_margins(trees: dict[int, list[Tree]]):
        return blocks.map(lambda b: (*b, {m: _added(np.full(len(b[2]), base), t, b[1]) for m, t in trees.items()})).persist(StorageLevel.MEMORY_AND_DISK)
    current = with_margins({m: [] for m in models})
    parts = current.getNumPartitions()
    try:
        while any(not v.done for v in models.values()):
            live = {m: v for m, v in models.items() if not v.done}
            if any(len(v.trees) - v.kept >= snapshot for v in live.values()):
                before, current = current, with_margins({m: v.trees for m, v in live.items()})
                for v in live.values():
                    v.kept = len(v.trees)
                current.count()
                before.unpersist()
            for v in live.values():
                v.start()
            while opened := {m: v for m, v in live.items() if v.front}:
                sums = _pass(current, {m: v.view() for m, v in opened.items()}, bins, unit, parts)
                for m, v in opened.items():
                    g, h, error = sums[m]
                    if v.level == 0 and _settled(v, error):
                        v.done, v.front = True, []
                        continue
                    _grow(v, g * unit, h, edges)
    finally:
        current.unpersist()
    return [_finished(v) for v in models.values()]


def _pass(blocks, views: dict, bins: int, unit: float, parts: int) -> dict:
    def task(part):
        total = None
        for block in part:
            own = _histograms(block, views, bins, unit)
            total = own if total is None else _merge(total, own)
        return [] if total is None else [total]
    sums = blocks.mapPartitions(task)
    return sums.reduce(_merge) if parts <= 32 else sums.treeReduce(_merge, depth=3)


def _settled(v: _Grown, error: np.ndarray) -> bool:
    """Note the validation error of the trees so far; whether the model is done."""
    n = len(v.trees)
    if error[1]:
        v.mae.append(float(error[0] / error[1]))
        if v.mae[n] < v.mae[v.best]:
            v.best = n
        stale = n - v.best >= v.spec.patience
    else:
        v.best, stale = n, False
    return stale or n >= v.spec.rounds


def _finished(v: _Grown) -> tuple[Boosted, Report]:
    trees = [Tree(t.feature, t.threshold, t.left, t.right, t.value) for t in v.trees[:v.best]]
    mean = np.where(v.splits > 0, v.gain / np.maximum(v.splits, 1), 0.0)
    share = mean / mean.sum() if mean.sum() else mean
    return Boosted(v.base, trees, share.tolist()), Report(v.best, len(v.trees), v.mae)
