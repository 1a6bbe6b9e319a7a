"""Gaussian hidden-state model over reading sequences, fitted and decoded by Spark (M1-M5).

A sequence may be arbitrarily long, so it is never handed to one task.  It is cut into chunks of at
most ``CHUNK`` rows, and both recursions are split at chunk borders: each chunk of a longer sequence is
reduced to one K x K operator per model; operators are multiplied in groups of ``FAN``, level by level,
up a tree; borders come back down it; and each chunk then runs its own rows between the vectors known
at its ends.  The result is exactly that of one long recursion.  Sequences of one chunk skip the tree.
One row per chunk carries all candidate models (state counts and seeds), and the numpy steps of a task
run over many chunks at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.aggregates import state_stats
from ..operators.windows import chrono_split
from ..session import dealt_checkpoint, durable_checkpoint, let_go
from . import recursions as R

CHUNK = 512
FAN = 512             # operators that one task multiplies
TASK_ROWS = 4096      # rows that are worth a task of their own
TIDY = 10             # steps after which the files of the steps before are let go
CENTRE_ROUNDS, CENTRE_SAMPLE = 10, 4096   # passes that place the first centres, and rows they are drawn from
CENTRE_CHUNKS = 8     # chunks whose rows are compared with all centres at once
MIN_COVAR, COVAR_PRIOR = 1e-3, 1e-2  # fixed values of the usual Gaussian estimator


class NotSettled(RuntimeError):
    """No candidate met the tolerance, or none was stable enough to be chosen."""


@dataclass
class Params:
    start: np.ndarray   # K
    trans: np.ndarray   # K x K
    mean: np.ndarray    # K x D
    var: np.ndarray     # K x D

    @property
    def k(self) -> int:
        return len(self.start)

    def log_emission(self, x: np.ndarray) -> np.ndarray:
        gap = (x[:, None, :] - self.mean[None]) ** 2 / self.var[None]
        return -0.5 * (gap.sum(2) + np.log(2 * np.pi * self.var).sum(1)[None])


@dataclass
class Scaler:
    mean: list[float]
    std: list[float]


@dataclass
class HmmModel:
    params: Params
    scaler: Scaler
    cols: list[str]
    log_likelihood: float
    converged: bool
    anomalous: list[int]
    thresholds: dict[str, float] | None = None   # mild and extreme bounds of the training rows


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> Scaler:
    """Mean and population deviation per column (a constant column scales by 1)."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return Scaler([row[f"m{i}"] for i in range(len(cols))],
                  [row[f"s{i}"] or 1.0 for i in range(len(cols))])


def apply_scaler(df: DataFrame, cols: Sequence[str], scaler: Scaler) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s)
                           for c, m, s in zip(cols, scaler.mean, scaler.std)})


def chunk_table(seqs: DataFrame, keys: Sequence[str], cols: Sequence[str],
                chunk: int = CHUNK, parts: int | None = None) -> DataFrame:
    """One row per chunk: at most ``chunk`` consecutive rows of a sequence, flattened; ``full`` where there may be a next one.

    With ``parts`` the chunks are dealt to so many tasks by key and number, and stay there when borders are joined.
    """
    position, ids = F.col("sequence_position"), [*keys, "sequence_id", "chunk"]
    row = F.struct(position.alias("p"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    rows = seqs.select(*keys, "sequence_id", F.floor(position / chunk).alias("chunk"), row.alias("_r"))
    grouped = (rows.repartition(parts, *ids) if parts else rows).groupBy(*ids).agg(F.array_sort(F.collect_list("_r")).alias("_r"))
    return grouped.select(*ids, F.col("_r")[0]["p"].alias("first_row"), (F.size("_r") >= chunk).alias("full"),
                          F.flatten(F.transform("_r", lambda r: r["x"])).alias("x"))


def _parts(seqs: DataFrame, n: int) -> int:
    """Tasks for ``n`` rows: one for as many as step together; for fewer rows, what the cluster runs at once."""
    return max(1, -(-n // R.TOGETHER), min(seqs.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)))


# --- distributed passes -------------------------------------------------------------------
def _key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{c}` {types[c]}" for c in [*keys, "sequence_id"])


def _last_chunk(chunks: DataFrame) -> int:
    return chunks.agg(F.max("chunk")).first()[0] or 0


def _offsets(models: Mapping[int, Params], size) -> dict[int, slice]:
    ends = np.cumsum([size(p.k) for p in models.values()])
    return {m: slice(e - size(p.k), e) for (m, p), e in zip(models.items(), ends.tolist(), strict=True)}


def _alike(models: Mapping[int, Params]) -> list[tuple[list[int], R.Alike]]:
    """The models of each state count, which take their steps together."""
    by_count: dict[int, list[int]] = {}
    for m, p in models.items():
        by_count.setdefault(p.k, []).append(m)
    return [(names, R.Alike([models[m] for m in names])) for names in by_count.values()]


def _operators(chunks: DataFrame, keys: Sequence[str], models: Mapping[int, Params], d: int, best: bool) -> DataFrame:
    """``ids, chunk, ops``: the operators of all models, one after another."""
    ids, squares = [*keys, "sequence_id"], _offsets(models, lambda k: k * k)
    width, alike = sum(p.k ** 2 for p in models.values()), _alike({} if best else models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ops, first = np.zeros((len(pdf), width)), (pdf["chunk"] == 0).to_numpy()
            for at, n, rows in R.stacks(pdf["x"].tolist(), d):
                for m, p in models.items() if best else ():
                    ops[at, squares[m]] = R.best_operators(p, n, rows, first[at]).reshape(len(at), -1)
                terms = None if best else R.row_terms(rows)
                for names, together in alike:
                    for m, op in zip(names, R.forward_operators(together, n, terms, first[at]), strict=True):
                        ops[at, squares[m]] = op.reshape(len(at), -1)
            yield pdf[[*ids, "chunk"]].assign(ops=list(ops))
    return chunks.select(*ids, "chunk", "x").mapInPandas(run, f"{_key_schema(chunks, keys)}, chunk bigint, ops array<double>")


def _product(ops: np.ndarray, best: bool) -> np.ndarray:
    """Of (n, ..., K, K) operators in their order; neighbours are multiplied pair by pair."""
    while len(ops) > 1:
        a, b = ops[0:len(ops) - 1:2], ops[1::2]
        pairs = (a[..., :, :, None] + b[..., None, :, :]).max(-2) if best else R.scaled(a @ b)
        ops = np.concatenate([pairs, ops[-1:]]) if len(ops) % 2 else pairs
    return ops[0]


def _same_size(models: Mapping[int, Params]) -> list[tuple[int, list[int]]]:
    return [(k, [m for m, p in models.items() if p.k == k]) for k in dict.fromkeys(p.k for p in models.values())]


def _grouped(ops: DataFrame, keys: Sequence[str], models: Mapping[int, Params], best: bool, fan: int) -> DataFrame:
    """The products of every ``fan`` neighbours: the next level of the tree."""
    ids, squares, width = [*keys, "sequence_id"], _offsets(models, lambda k: k * k), sum(p.k ** 2 for p in models.values())
    sizes = _same_size(models)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        flat, out = np.stack(pdf["ops"].tolist()), np.empty(width)
        for k, names in sizes:
            own = np.stack([flat[:, squares[m]].reshape(-1, k, k) for m in names], axis=1)
            for m, total in zip(names, _product(own, best), strict=True):
                out[squares[m]] = total.ravel()
        return pdf[[*ids, "up"]].head(1).rename(columns={"up": "chunk"}).assign(ops=[out])
    return ops.withColumn("up", F.floor(F.col("chunk") / fan)).groupBy(*ids, "up").applyInPandas(
        run, f"{_key_schema(ops, keys)}, chunk bigint, ops array<double>")


def _borders(ops: DataFrame, keys: Sequence[str], models: Mapping[int, Params], most: int, best: bool, fan: int = FAN) -> DataFrame:
    """``ids, chunk, head, tail``: what each chunk must know at its two ends, for all models.

    Forward-backward: the vector before it and the one after it. Best path: the state before it and its last state.
    """
    ids, states, squares = [*keys, "sequence_id"], _offsets(models, lambda k: k), _offsets(models, lambda k: k * k)
    one, sizes = _offsets(models, lambda k: 1), _same_size(models)
    levels = [ops]
    while most >= fan:
        most //= fan
        levels.append(durable_checkpoint(_grouped(levels[-1], keys, models, best, fan)))

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        flat, n = np.stack(pdf["ops"].tolist()), len(pdf)
        given = "head" in pdf
        size = len(models) if best else sum(p.k for p in models.values())
        heads, tails = np.zeros((n, size)), np.zeros((n, size))
        head, tail = (np.asarray(pdf[side].iloc[0], float) if given else None for side in ("head", "tail"))
        for m, p in models.items() if best else ():
            at = one[m]
            heads[:, at], tails[:, at] = _best_between(flat[:, squares[m]].reshape(-1, p.k, p.k), *(v if v is None else v[at] for v in (head, tail)))
        for k, names in () if best else sizes:
            own = np.stack([flat[:, squares[m]].reshape(-1, k, k) for m in names], axis=1)
            ends = [v if v is None else np.stack([v[states[m]] for m in names]) for v in (head, tail)]
            for m, before, after in zip(names, *_vectors_between(own, *ends), strict=True):
                heads[:, states[m]], tails[:, states[m]] = before, after
        return pdf[[*ids, "chunk"]].assign(head=list(heads), tail=list(tails))
    schema = f"{_key_schema(ops, keys)}, chunk bigint, head array<double>, tail array<double>"
    known = levels.pop().groupBy(*ids).applyInPandas(inner, schema)
    while levels:
        known = durable_checkpoint(known.withColumnRenamed("chunk", "up"))
        known = levels.pop().withColumn("up", F.floor(F.col("chunk") / fan)).join(known, [*ids, "up"]).groupBy(
            *ids, "up").applyInPandas(inner, schema)
    return known


def _vectors_between(ops: np.ndarray, head: np.ndarray | None, tail: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(S, n, K) before and after each of the operators (n, S, K, K) of S models."""
    n, size, k = ops.shape[:3]
    heads, tails = np.empty((n, size, 1, k)), np.empty((n, size, k, 1))
    state = (np.tile(np.eye(k)[0], (size, 1)) if head is None else head)[:, None]   # the first operator starts from ``start`` whatever is before
    for i, op in enumerate(ops):
        heads[i] = state
        state = state @ op
        state /= np.maximum(state.sum(2, keepdims=True), 1e-300)
    state = (np.ones((size, k)) if tail is None else tail)[:, :, None]
    for i in range(n - 1, -1, -1):
        tails[i] = state
        state = ops[i] @ state
        state /= np.maximum(state.sum(1, keepdims=True), 1e-300)
    return heads[:, :, 0].transpose(1, 0, 2), tails[..., 0].transpose(1, 0, 2)


def _best_between(ops: np.ndarray, head: np.ndarray | None, tail: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The path of border states from a known one to a known (or the best) one."""
    n, k = len(ops), ops.shape[1]
    score, before = np.where(np.arange(k) == (0 if head is None else int(head[0])), 0.0, -np.inf), []
    for op in ops:
        before.append(score)
        score = (score[:, None] + op).max(0)
    state = int(score.argmax()) if tail is None else int(tail[0])
    heads, tails = np.empty((n, 1)), np.empty((n, 1))
    for i in range(n - 1, -1, -1):
        tails[i] = state
        state = int((before[i] + ops[i][:, state]).argmax())
        heads[i] = state
    return heads, tails


def _with_borders(chunks: DataFrame, keys: Sequence[str], models: Mapping[int, Params], d: int, best: bool, fan: int,
                  most: int | None = None) -> DataFrame:
    """Chunks with ``head`` and ``tail``; null where the sequence is the chunk. Rows of chunks stay where they are: borders go to them."""
    ids = [*keys, "sequence_id", "chunk"]
    most = _last_chunk(chunks) if most is None else most
    if not most:
        blank = F.lit(None).cast("array<double>")
        return chunks.withColumns({"head": blank, "tail": blank})
    several = chunks.filter(" and ".join(["(chunk > 0 or full)", *[f"`{c}` is not null" for c in ids]]))   # null ids meet no border
    ops = durable_checkpoint(_operators(several, keys, models, d, best))
    return chunks.join(_borders(ops, keys, models, most, best, fan).hint("shuffle_hash"), ids, "left")


def _expectations(chunks: DataFrame, keys: Sequence[str], models: Mapping[int, Params], d: int, fan: int = FAN,
                  most: int | None = None) -> dict:
    """One E-step for all models: summed statistics (a few hundred numbers per model)."""
    states, alike = _offsets(models, lambda k: k), _alike(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            first, head, tail = (pdf["chunk"] == 0).to_numpy(), pdf["head"].tolist(), pdf["tail"].tolist()
            for at, n, rows in R.stacks(pdf["x"].tolist(), d):
                terms, blank = R.row_terms(rows), np.ones(max(v.stop for v in states.values()))
                ends = [np.stack([blank if side[i] is None else side[i] for i in at]) for side in (head, tail)]
                for names, together in alike:
                    own = [np.stack([side[:, states[m]] for m in names]) for side in ends]
                    for m, stats in zip(names, R.statistics(together, n, terms, first[at], *own), strict=True):
                        sums[m] = sums[m] + stats if m in sums else stats
        yield pd.DataFrame([(m, i, v) for m, s in sums.items() for i, v in enumerate(s)], columns=["model", "i", "v"])
    bordered = _with_borders(chunks, keys, models, d, False, fan, most).select("chunk", "x", "head", "tail")
    rows = bordered.mapInPandas(run, "model int, i int, v double").groupBy("model", "i").agg(F.sum("v").alias("v")).collect()
    found: dict[int, dict[int, float]] = {m: {} for m in models}
    for r in rows:
        found[r["model"]][r["i"]] = r["v"]
    sizes = {m: p.k + p.k ** 2 + p.k + 2 * p.k * d + 1 for m, p in models.items()}
    return {m: np.array([found[m].get(i, 0.0) for i in range(sizes[m])]) for m in models}


def _maximise(stats: np.ndarray, k: int, d: int) -> tuple[Params, float]:
    cut = np.cumsum([k, k * k, k, k * d, k * d])
    start, trans, weight, sums, squares, rest = np.split(stats, cut)
    trans, sums, squares = trans.reshape(k, k), sums.reshape(k, d), squares.reshape(k, d)
    start = start / max(start.sum(), 1e-300)
    total = trans.sum(1, keepdims=True)
    trans = np.where(total > 0, trans / np.maximum(total, 1e-300), 1.0 / k)
    w = np.maximum(weight, 1e-10)[:, None]
    mean = sums / w
    var = (COVAR_PRIOR + np.maximum(squares - w * mean ** 2, 0.0)) / w
    return Params(start, trans, mean, np.maximum(var, MIN_COVAR * 1e-3)), float(rest[0])


def expected_counts(seqs: DataFrame, keys: Sequence[str], cols: Sequence[str], params: Params) -> dict[str, np.ndarray]:
    """What one EM step adds up over scaled ``seqs``: start, trans, weight, sums, squares, and the log-likelihood."""
    k, d = params.k, len(cols)
    chunks = dealt_checkpoint(chunk_table(seqs, keys, cols, parts=_parts(seqs, seqs.count())))
    flat = _expectations(chunks, keys, {0: params}, d)[0]
    start, trans, weight, sums, squares, rest = np.split(flat, np.cumsum([k, k * k, k, k * d, k * d]))
    return {"start": start, "trans": trans.reshape(k, k), "weight": weight, "sums": sums.reshape(k, d),
            "squares": squares.reshape(k, d), "log_likelihood": rest[0]}


def spread_out(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` rows of the sample, each drawn by its squared distance from those before."""
    draw = np.random.default_rng(seed)
    chosen = [sample[draw.integers(len(sample))]]
    far = ((sample - chosen[0]) ** 2).sum(1)
    while len(chosen) < k:
        total = far.sum()
        at = draw.choice(len(sample), p=far / total) if total > 0 else draw.integers(len(sample))
        chosen.append(sample[at] + (0.0 if total > 0 else 1e-3 * len(chosen)))   # fewer distinct rows than states
        far = np.minimum(far, ((sample - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def _centres(chunks: DataFrame, seqs: DataFrame, cols: Sequence[str], pairs: Mapping[int, tuple[int, int]],
             rounds: int = CENTRE_ROUNDS, size: int = CENTRE_SAMPLE) -> dict[int, np.ndarray]:
    """Cluster centres for every ``(k, seed)``: drawn from at most ``size`` rows, then moved by passes over all rows."""
    d = len(cols)
    x = F.array(*[F.col(c).cast("double") for c in cols])
    sample = np.array([r["x"] for r in seqs.select(x.alias("x")).orderBy(F.xxhash64("x"), "x").limit(size).collect()])
    centres = {m: spread_out(sample, k, seed) for m, (k, seed) in pairs.items()}

    def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends = np.cumsum([len(c) for c in centres.values()]).tolist()
        at, together = {m: slice(e - len(c), e) for (m, c), e in zip(centres.items(), ends)}, np.concatenate(list(centres.values()))
        length, total = (together * together).sum(1), np.zeros((len(together), d + 1))
        for pdf in batches:
            x = pdf["x"].tolist()
            for k in range(0, len(x), CENTRE_CHUNKS):
                rows = np.concatenate([np.asarray(v, float) for v in x[k:k + CENTRE_CHUNKS]]).reshape(-1, d)
                gap, near = -2 * together @ rows.T, np.zeros((len(together), len(rows)))
                gap += length[:, None]
                for own in at.values():
                    least, free = np.minimum.reduce(gap[own], axis=0), np.ones(len(rows), bool)
                    for j in range(own.start, own.stop):   # the first of equal ones
                        hit = (gap[j] == least) & free
                        near[j], free = hit, free ^ hit
                total += near @ np.column_stack([rows, np.ones(len(rows))])
        sums = {m: total[own] for m, own in at.items()}
        yield pd.DataFrame([(m, i, v) for m, s in sums.items() for i, v in enumerate(s.ravel())], columns=["model", "i", "v"])
    for _ in range(rounds):
        found = chunks.select("x").mapInPandas(moved, "model int, i int, v double").groupBy("model", "i").agg(F.sum("v").alias("v")).collect()
        totals = {m: np.zeros(c.size + len(c)) for m, c in centres.items()}
        for r in found:
            totals[r["model"]][r["i"]] = r["v"]
        for m, c in centres.items():
            t = totals[m].reshape(len(c), d + 1)
            centres[m] = np.where(t[:, -1:] > 0, t[:, :-1] / np.maximum(t[:, -1:], 1.0), c)
    return centres


def fit_candidates(seqs: DataFrame, keys: Sequence[str], cols: Sequence[str], ks: Sequence[int],
                   seeds: Sequence[int], iters: int, tol: float) -> dict[tuple[int, int], tuple[Params, float, bool]]:
    """EM for every ``(k, seed)``: parameters, their likelihood, and whether the gain fell below ``tol``.

    ``seqs`` hold scaled features, ids and positions. Without rows this is ``NotSettled``.
    """
    d = len(cols)
    spread = seqs.agg(*[F.var_pop(c) for c in cols], F.count(F.lit(1)).alias("_n")).first()
    if not spread["_n"]:
        raise NotSettled("no complete rows to train on")
    chunks = dealt_checkpoint(chunk_table(seqs, keys, cols, parts=_parts(seqs, spread["_n"])))
    var = np.array([v or 0.0 for v in spread[:d]])
    names = {i: pair for i, pair in enumerate((k, s) for k in ks for s in seeds)}
    live = {m: Params(np.full(len(c), 1.0 / len(c)), np.full((len(c), len(c)), 1.0 / len(c)), c, np.tile(var + MIN_COVAR, (len(c), 1)))
            for m, c in _centres(chunks, seqs, cols, names).items()}
    most = _last_chunk(chunks)
    done: dict[int, tuple[Params, float, bool]] = {}
    last: dict[int, float] = {}
    for it in range(iters + 1):   # the last pass only scores the parameters of the last step
        stats = _expectations(chunks, keys, live, d, most=most)
        if it % TIDY == TIDY - 1:
            let_go(chunks.sparkSession)
        for m in list(live):
            params, loglik = _maximise(stats[m], live[m].k, d)   # the likelihood is that of live[m]
            settled = m in last and loglik - last[m] < tol
            if settled or it == iters:
                done[m] = (live[m], loglik, settled)
                del live[m]
            else:
                live[m], last[m] = params, loglik
        if not live:
            break
    return {names[m]: v for m, v in done.items()}


def fit_hmm(seqs: DataFrame, keys: Sequence[str], cols: Sequence[str], k: int,
            seeds: Sequence[int] = tuple(K.HMM_SEEDS), iters: int = K.HMM_ITERATIONS,
            tol: float = K.HMM_TOLERANCE) -> tuple[Params, float]:
    fits = fit_candidates(seqs, keys, cols, [k], seeds, iters, tol)
    good = [(loglik, -s, p) for (_, s), (p, loglik, settled) in fits.items() if settled and np.isfinite(loglik)]
    if not good:
        raise NotSettled(f"no model with {k} states settled within {iters} steps")
    best = max(good, key=lambda g: g[:2])
    return best[2], best[0]


def decode(seqs: DataFrame, keys: Sequence[str], cols: Sequence[str], models: Mapping[int, Params], fan: int = FAN) -> DataFrame:
    """Most likely state per row and model: keys, sequence_id, sequence_position, model, state."""
    ids, d, one = [*keys, "sequence_id"], len(cols), _offsets(models, lambda k: 1)
    chunks = dealt_checkpoint(chunk_table(seqs, keys, cols, parts=_parts(seqs, seqs.count())))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            first, head, tail = (pdf["chunk"] == 0).to_numpy(), pdf["head"].tolist(), pdf["tail"].tolist()
            for m, p in models.items():
                states: list = [None] * len(pdf)
                for at, n, rows in R.stacks(pdf["x"].tolist(), d):
                    ends = [np.array([blank if side[i] is None else int(side[i][one[m]][0]) for i in at]) for side, blank in ((head, 0), (tail, -1))]
                    for i, path in zip(at, R.best_paths(p, n, rows, first[at], *ends), strict=True):
                        states[i] = path
                yield pdf[[*ids, "first_row"]].assign(model=m, states=states)[[*ids, "model", "first_row", "states"]]
    paths = _with_borders(chunks, keys, models, d, True, fan).select(*ids, "chunk", "first_row", "x", "head", "tail").mapInPandas(
        run, f"{_key_schema(chunks, keys)}, model int, first_row bigint, states array<int>")
    return paths.select(*ids, "model", "first_row", F.posexplode("states").alias("_p", "state")).select(
        *ids, (F.col("first_row") + F.col("_p")).alias("sequence_position"), "model", "state")


def state_shares(decoded: DataFrame, bounds: Mapping[str, tuple[str | float, str | float]]) -> DataFrame:
    return state_stats(decoded, "state", ["model"], bounds)


def anomalous_states(stats: DataFrame, cutoff: float, share: str = "prop_") -> list[int]:
    """States whose largest out-of-bounds share reaches the cutoff (at most K rows collected)."""
    shares = [F.col(c) for c in stats.columns if c.startswith(share)]
    return sorted(r["state"] for r in stats.filter(F.greatest(*shares) >= cutoff).select("state").collect())


def _f1(rows: DataFrame, label: str) -> DataFrame:
    said, real = F.col("said"), F.col(label) == 1
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.groupBy("model", "cutoff").agg(F.coalesce(F.try_divide(
        2.0 * n(said & real), n(said) + n(real)), F.lit(0.0)).alias("f1"))


def select_hmm(seqs: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], label: str,
               bounds: Mapping[str, tuple[str | float, str | float]],
               ks: Sequence[int] = tuple(K.HMM_STATE_COUNTS), cutoffs: Sequence[float] = tuple(K.HMM_CUTOFFS),
               seeds: Sequence[int] = tuple(K.HMM_SEEDS), iters: int = K.HMM_ITERATIONS,
               tol: float = K.HMM_TOLERANCE, min_rows: int = K.HMM_MIN_STATE_ROWS) -> tuple[HmmModel, dict]:
    """State count and cutoff by validation F1, refit on train + validation, one test score.

    ``seqs``: complete rows with ``sequence_id``, ``sequence_position``, the label and the raw
    columns named in ``bounds``.  Splits are by distinct days per key; a sequence crossing a
    split border is two sequences.
    """
    parts = durable_checkpoint(chrono_split(seqs, keys, ts, by="day"))
    # positions restart at 0 within a split (all rows of a sequence part are consecutive)
    low = parts.groupBy(*keys, "sequence_id", "split").agg(F.min("sequence_position").alias("_lo"))
    code = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).otherwise(2)
    parts = durable_checkpoint(parts.join(low, [*keys, "sequence_id", "split"]).withColumns({
        "sequence_position": F.col("sequence_position") - F.col("_lo"),
        "sequence_id": F.col("sequence_id") * 3 + code}).drop("_lo"))
    of = lambda *names: parts.filter(F.col("split").isin(*names))
    scaler = fit_scaler(of("train"), cols)
    fits = fit_candidates(apply_scaler(of("train"), cols, scaler), keys, cols, ks, seeds, iters, tol)
    models: dict[int, Params] = {}
    for k in ks:
        best = max(((ll, -s, p) for (kk, s), (p, ll, ok) in fits.items() if kk == k and ok and np.isfinite(ll)),
                   default=None, key=lambda g: g[:2])
        if best is not None:
            models[k] = best[2]
    if not models:
        raise NotSettled(f"no candidate settled within {iters} steps")
    row_id = [*keys, "sequence_id", "sequence_position"]
    raw = parts.select(*row_id, "split", label, *[F.col(c).alias(f"_raw_{c}") for c in bounds])

    def labelled(part: DataFrame, with_models: Mapping[int, Params], scale: Scaler) -> DataFrame:
        states = decode(apply_scaler(part, cols, scale), keys, cols, with_models)
        return states.join(raw, row_id).withColumnsRenamed({f"_raw_{c}": c for c in bounds})
    decoded = durable_checkpoint(labelled(of("train", "validation"), models, scaler))
    shares = state_shares(decoded.filter("split = 'train'"), bounds)
    props = [F.col(c) for c in shares.columns if c.startswith("prop_")]
    worst = shares.select("model", "state", "n_points", F.greatest(*props).alias("worst"))
    tried = decoded.filter("split = 'validation'").join(worst, ["model", "state"], "left").withColumn(
        "cutoff", F.explode(F.array(*[F.lit(float(c)) for c in cutoffs]))).withColumn(
        "said", F.coalesce(F.col("worst") >= F.col("cutoff"), F.lit(False)))
    size = worst.groupBy("model").agg(F.min("n_points").alias("smallest"))
    ranking = _f1(tried, label).join(size, "model").filter(F.col("smallest") >= min_rows).orderBy(
        F.col("f1").desc(), "model", "cutoff")
    best = ranking.first()
    if best is None:
        raise NotSettled("no stable configuration")
    final_scaler = fit_scaler(of("train", "validation"), cols)
    params, loglik = fit_hmm(apply_scaler(of("train", "validation"), cols, final_scaler), keys, cols,
                             best["model"], seeds, iters, tol)
    final = durable_checkpoint(labelled(parts, {best["model"]: params}, final_scaler))
    odd = anomalous_states(state_shares(final.filter("split != 'test'"), bounds), best["cutoff"])
    said = final.filter("split = 'test'").withColumn("cutoff", F.lit(best["cutoff"])).withColumn(
        "said", F.col("state").isin(odd) if odd else F.lit(False))
    test = _f1(said, label).first()
    model = HmmModel(params, final_scaler, list(cols), loglik, True, odd)
    return model, {"n_states": best["model"], "cutoff": best["cutoff"], "validation_f1": best["f1"],
                   "test_f1": test["f1"] if test else 0.0}


def decode_rows(seqs: DataFrame, keys: Sequence[str], model: HmmModel) -> DataFrame:
    """Sequence rows with ``state`` and ``is_anomaly`` (the input of episode detection)."""
    states = decode(apply_scaler(seqs, model.cols, model.scaler), keys, model.cols, {0: model.params}).drop("model")
    odd = F.col("state").isin(model.anomalous) if model.anomalous else F.lit(False)
    return seqs.join(states, [*keys, "sequence_id", "sequence_position"]).withColumn("is_anomaly", odd)
