"""Numpy recursions of the hidden-state model, over many chunks of rows at a time.

Chunks of a batch are put in the order of their lengths, so that step ``t`` of all of them is one
operation on the first ``m`` chunks, those longer than ``t``. A model has ``start`` (K), ``trans``
(K x K), ``mean`` and ``var`` (K x D).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

TOGETHER = 1 << 17   # rows, at the length of the longest, of the chunks that step together
STEPS_AT_ONCE = 1 << 15   # densities that are worked on at once


def stacks(x: Sequence[np.ndarray], d: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``order, lengths, rows`` of some flat chunks at a time, long ones first; ``rows`` is (B, L, D)."""
    lengths = np.array([len(v) // d for v in x], np.int64)
    order = np.argsort(-lengths, kind="stable")
    k = 0
    while k < len(order):
        at = order[k:k + max(1, TOGETHER // max(1, int(lengths[order[k]])))]
        k, n = k + len(at), lengths[at]
        rows = np.zeros((len(at), n[0], d))
        for i, c in enumerate(at):
            rows[i, :n[i]] = np.asarray(x[c], float).reshape(-1, d)
        yield at, n, rows


def log_emission(p, rows: np.ndarray) -> np.ndarray:
    """(B, L, K) from products of the rows and their squares with the parameters."""
    b, length, d = rows.shape
    flat, weight = rows.reshape(-1, d), 1.0 / p.var
    gap = (flat * flat) @ weight.T - 2 * flat @ (p.mean * weight).T + (p.mean ** 2 * weight).sum(1)
    return (-0.5 * (gap + np.log(2 * np.pi * p.var).sum(1))).reshape(b, length, -1)


def longer(n: np.ndarray, t: int) -> int:
    """How many of the chunks, long ones first, have a row ``t``."""
    return int(np.searchsorted(-n, -t, side="left"))


class Alike:
    """Several models of one state count, whose steps are taken together: S models, K states.

    Arrays have the chunks last, so that every operation runs over many neighbours in memory, however few the states.
    """

    def __init__(self, models: Sequence):
        self.size, self.k = len(models), len(models[0].start)
        self.start, self.trans = np.stack([p.start for p in models]), np.stack([p.trans for p in models])
        self.onward = np.ascontiguousarray(self.trans.transpose(0, 2, 1))
        mean, weight = (np.concatenate(v) for v in ([p.mean for p in models], [1.0 / p.var for p in models]))
        constant = (mean ** 2 * weight).sum(1) + np.concatenate([np.log(2 * np.pi * p.var).sum(1) for p in models])
        self.weights = -0.5 * np.column_stack([weight, -2 * mean * weight, constant])

    def emissions(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(L, S, K, B) densities of which the largest of a row is one, and (L, S, B) what their logs were less."""
        length, _, batch = terms.shape
        b, top = np.empty((length, self.size, self.k, batch)), np.empty((length, self.size, batch))
        few = max(1, STEPS_AT_ONCE // (self.size * self.k * batch))
        for t in range(0, length, few):
            part, most = b[t:t + few], top[t:t + few]
            np.matmul(self.weights, terms[t:t + few], out=part.reshape(len(part), -1, batch))
            np.maximum.reduce(part, axis=2, out=most)
            part -= most[:, :, None]
            np.exp(part, out=part)
        return b, top


def row_terms(rows: np.ndarray) -> np.ndarray:
    """(L, 2 * D + 1, B): squares, values and a one, which all models' emissions and sums are products with."""
    batch, length, d = rows.shape
    out = np.ones((length, 2 * d + 1, batch))
    out[:, d:2 * d] = rows.transpose(1, 2, 0)
    np.multiply(out[:, d:2 * d], out[:, d:2 * d], out=out[:, :d])
    return out


def forward_operators(p: Alike, n: np.ndarray, terms: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(S, B, K, K): each chunk's scaled product of transitions and emissions; a first chunk starts from ``start``."""
    b, _ = p.emissions(terms)
    done = np.empty((p.size, p.k, p.k, len(n)))   # to, from
    op = np.empty_like(done)
    op[:] = np.eye(p.k)[None, :, :, None]
    for t in range(len(b)):
        m, was = longer(n, t), op.shape[-1]
        if m < was:
            done[..., m:was] = op[..., m:]
            op = np.ascontiguousarray(op[..., :m])
        step = np.matmul(p.onward, op.reshape(p.size, p.k, -1)).reshape(op.shape)
        if t == 0:
            step[..., first] = p.start[:, :, None, None]
        step *= b[t, :, :, None, :m]
        total = np.add.reduce(step.reshape(p.size, p.k * p.k, m), axis=1)
        if total.all():
            np.divide(step, total[:, None, None], out=op)
        else:
            seen = total[:, None, None] > 0
            op = np.where(seen, step / np.where(seen, total[:, None, None], 1.0), 1.0)
    done[..., :op.shape[-1]] = op
    return done.transpose(0, 3, 2, 1)


def scaled(op: np.ndarray) -> np.ndarray:
    """Products whose largest entry is one; where nothing explains the rows, all entries are alike."""
    top = op.max((-2, -1), keepdims=True)
    return np.where(top > 0, op / np.where(top > 0, top, 1.0), 1.0)


def statistics(p: Alike, n: np.ndarray, terms: np.ndarray, first: np.ndarray, alpha_in: np.ndarray, beta_out: np.ndarray) -> np.ndarray:
    """Expected counts of each model summed over the chunks, (S, ...): start K, transitions K*K, weight K, sums K*D, squares
    K*D; log-likelihood. ``alpha_in`` and ``beta_out`` are (S, B, K)."""
    b, top = p.emissions(terms)
    length, size, k, batch = b.shape
    alpha, totals = np.empty((length + 1, size, k, batch)), np.ones((length, size, batch))
    alpha[0] = alpha_in.transpose(0, 2, 1)              # before the chunk; row t is at t + 1
    for t in range(length):
        m = longer(n, t)
        a = np.matmul(p.onward, alpha[t, :, :, :m])
        if t == 0:
            a[:, :, first] = p.start[:, :, None]
        a *= b[t, :, :, :m]
        total = np.add.reduce(a, axis=1, out=totals[t, :, :m])
        if total.all():
            np.divide(a, total[:, None], out=alpha[t + 1, :, :, :m])
        else:
            seen = total[:, None] > 0
            alpha[t + 1, :, :, :m] = np.where(seen, a / np.where(seen, total[:, None], 1.0), 1.0 / k)
    after = np.ascontiguousarray(beta_out.transpose(0, 2, 1), float)
    xi, spread, begun = np.zeros((size, k, k)), np.zeros((size * k, terms.shape[1])), np.zeros((size, k))
    for t in range(length - 1, -1, -1):
        m = longer(n, t)
        beta, before = after[:, :, :m], alpha[t, :, :, :m]
        gamma = alpha[t + 1, :, :, :m] * beta
        total = np.add.reduce(gamma, axis=1)
        gamma /= np.maximum(total, 1e-300)[:, None]
        spread += np.matmul(gamma.reshape(size * k, m), terms[t, :, :m].T)
        ahead = b[t, :, :, :m] * beta
        back = np.matmul(p.trans, ahead)
        # a row's moves weigh one together: their sum is that of alpha * beta before alpha was scaled
        total *= totals[t, :, :m]
        share = 1.0 / np.maximum(total, 1e-300)
        if t == 0:
            begun, share[:, first] = gamma[:, :, first].sum(2), 0.0
        ahead *= share[:, None]
        xi += np.matmul(before, ahead.transpose(0, 2, 1))
        np.divide(back, np.maximum(np.add.reduce(back, axis=1), 1e-300)[:, None], out=beta)
    there = (np.arange(length)[:, None] < n)[:, None]   # (L, 1, B)
    loglik = ((np.log(np.maximum(totals, 1e-300)) + top) * there).sum((0, 2))
    d, spread = terms.shape[1] // 2, spread.reshape(size, k, -1)
    parts = [begun, p.trans * xi, spread[:, :, 2 * d], spread[:, :, d:2 * d], spread[:, :, :d], loglik]
    return np.concatenate([v.reshape(size, -1) for v in parts], axis=1)


def logs(p) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(divide="ignore"):
        return np.log(p.trans), np.log(p.start)


def best_operators(p, n: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(B, K, K): the best log score from the state before the chunk to its last state."""
    la, ls = logs(p)
    logb = log_emission(p, rows)
    op = np.tile(np.where(np.eye(p.k) > 0, 0.0, -np.inf), (len(n), 1, 1))
    for t in range(rows.shape[1]):
        m = longer(n, t)
        step = (op[:m, :, :, None] + la).max(2)
        if t == 0:
            step[first] = ls
        op[:m] = step + logb[:m, t, None, :]
    return op


def best_paths(p, n: np.ndarray, rows: np.ndarray, first: np.ndarray, state_in: np.ndarray, state_out: np.ndarray) -> list[np.ndarray]:
    """The most likely states of every chunk between the states known at its borders; ``state_out`` below 0 is open."""
    la, ls = logs(p)
    logb = log_emission(p, rows)
    batch, length, k = logb.shape
    back = np.zeros((batch, length, k), np.int8)
    score = np.where(first[:, None], ls, la[state_in]) + logb[:, 0]
    for t in range(1, length):
        m = longer(n, t)
        through = score[:m, :, None] + la
        back[:m, t] = through.argmax(1)
        score[:m] = through.max(1) + logb[:m, t]
    state = np.where(state_out >= 0, state_out, score.argmax(1))
    path = np.zeros((batch, length), np.int64)
    for t in range(length - 1, -1, -1):
        m = longer(n, t)
        path[:m, t] = state[:m]
        if t:
            state[:m] = back[np.arange(m), t, state[:m]]
    return [path[i, :n[i]] for i in range(batch)]
