"""Byte-level BPE by monoid tree reduction.

Every pre-token of a text is encoded for itself: it is cut into leaves of a few bytes, all leaves of a
batch are merged by rank in one array, and neighbours are joined up the tree. Ids form a monoid under
``joined``: a join re-encodes a window of tokens around the boundary, and doubles it until its
outermost tokens are those the halves had there. Decoding concatenates the tokens' bytes up the same
kind of tree.

Why the window is enough: a sequence of tokens is the encoding of its bytes exactly where every two
neighbours ``a, b`` encode to ``a, b``. (Take the first merge across a boundary: until then merges
inside the two tokens came in the order they would have come in had nothing else been there, so it
would have happened to the two alone as well.) The window's tokens are an encoding, so are the
halves', and where both share the outermost token all neighbours are settled.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_counts import SPACE

MODEL = "byte_bpe_multi_50k.tiktoken"
LEAF = 16            # bytes of a leaf of the tree
LEAVES = 1 << 15     # leaves that are merged in one array
FEW = 64             # bytes up to which looking for the lowest rank again and again is faster than a heap
NEVER = 1 << 40
KNOWN = 400_000      # pieces whose ids a worker remembers
AT_ONCE = 1 << 20    # characters of text whose pieces are encoded together
SHORT = 64           # characters of the longest such piece
BRANCH = 4096        # tokens of a leaf of the decoding tree
ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def split_pattern(pattern: str = public_tokenizers.PATTERN) -> regex.Pattern:
    r"""The pattern with ``\s`` spelled out as Unicode White_Space, which is what the rank file's library takes it for."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))


class ByteEncoder:
    """Ranks of one file; ids are ranks."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("not every byte has a rank")
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        pairs = sorted((a << 32 | b, rank) for token, rank in self.ranks.items() for k in range(1, len(token))
                       if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None)
        self.pairs, self.made = (np.array(c, np.int64) for c in (zip(*pairs, strict=True) if pairs else ([], [])))
        self.start = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.split = split_pattern(pattern)
        self.known: dict[str, bytes] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What neighbouring ids merge to, ``NEVER`` where they do not; an id below 0 is no neighbour."""
        if not len(self.pairs):
            return np.full(len(left), NEVER, np.int64)
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where((self.pairs[at] == keys) & (left >= 0) & (right >= 0), self.made[at], NEVER)

    def merged_leaves(self, leaves: list[bytes]) -> list[list[int]]:
        """As ``merged`` of each, for strings of at most ``LEAF`` bytes: one merge of every string at a time."""
        lengths = np.fromiter(map(len, leaves), np.int64, len(leaves))
        cells = np.arange(LEAF + 1)
        ids = np.full((len(leaves), LEAF + 1), -1, np.int64)   # the last column stays empty
        ids[cells < lengths[:, None]] = self.start[np.frombuffer(b"".join(leaves), np.uint8)]
        ranks = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(leaves), LEAF)
        rows = np.arange(len(leaves))
        while True:
            at = ranks[rows].argmin(axis=1)   # the leftmost of the lowest
            rank = ranks[rows, at]
            rows, at, rank = (x[rank < NEVER] for x in (rows, at, rank))
            if not len(rows):
                break
            moved = np.minimum(cells + (cells > at[:, None]), LEAF)
            ids[rows] = np.take_along_axis(ids[rows], moved, 1)
            ids[rows, at] = rank
            ranks[rows] = np.take_along_axis(ranks[rows], np.minimum(moved[:, :-1], LEAF - 1), 1)
            ranks[rows, LEAF - 1] = NEVER
            ranks[rows, at] = self.pair_ranks(rank, ids[rows, at + 1])
            inner = at > 0
            r, k = rows[inner], at[inner]
            ranks[r, k - 1] = self.pair_ranks(ids[r, k - 1], rank[inner])
        counts = (ids >= 0).sum(axis=1).tolist()
        return [row[:n] for row, n in zip(ids.tolist(), counts, strict=True)]

    def merged(self, data: bytes) -> list[int]:
        """Ids of a byte string by merging its lowest pair, the leftmost of equal ones, until none has a rank."""
        if len(data) > FEW:
            return self._merged_by_heap(data)
        rank, parts = self.ranks.get, [data[k:k + 1] for k in range(len(data))]
        pairs = [rank(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best = min((p for p in pairs if p is not None), default=None)
            if best is None:
                return [self.ranks[p] for p in parts]
            k = pairs.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = rank(parts[k - 1] + parts[k])
            if k < len(pairs):
                pairs[k] = rank(parts[k] + parts[k + 1])

    def _merged_by_heap(self, data: bytes) -> list[int]:
        n, rank = len(data), self.ranks.get
        end = list(range(1, n + 1))        # of the part that starts at each place; 0 once it is merged away
        before = list(range(-1, n))        # start of the part to its left
        heap = [(r, k, k + 1, k + 2) for k in range(n - 1) if (r := rank(data[k:k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if end[a] != b or b >= n or end[b] != c:
                continue
            end[a], end[b] = c, 0
            if c < n:
                before[c] = a
                if (r := rank(data[a:end[c]])) is not None:
                    heapq.heappush(heap, (r, a, c, end[c]))
            if a:
                left = before[a]
                if (r := rank(data[left:c])) is not None:
                    heapq.heappush(heap, (r, left, a, c))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[data[at:end[at]]])
            at = end[at]
        return out

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the two byte strings put together."""
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merged(b"".join(map(self.bytes_of.__getitem__, chain(left[-i:], right[:j]))))
            left_holds = i == len(left) or window[0] == left[-i]
            right_holds = j == len(right) or window[-1] == right[j - 1]
            if left_holds and right_holds:
                return left[:-i] + window + right[j:]
            i, j = (i if left_holds else 2 * i), (j if right_holds else 2 * j)

    def reduced(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of every byte string by its tree: leaves, joined with their neighbours level by level."""
        cuts = [[p[k:k + LEAF] for k in range(0, len(p), LEAF)] for p in pieces]
        leaves = list(chain.from_iterable(cuts))
        ids = chain.from_iterable(self.merged_leaves(leaves[k:k + LEAVES]) for k in range(0, len(leaves), LEAVES))
        return [self._up([next(ids) for _ in cut]) for cut in cuts]

    def _up(self, level: list[list[int]]) -> list[int]:
        while len(level) > 1:
            level = [self.joined(*level[k:k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0] if level else []

    def encoded_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Little-endian unsigned 32-bit ids of matches of the pattern; a piece in the vocabulary is its own token."""
        data = [p.encode() for p in pieces]
        trees = iter(self.reduced([d for d in data if d not in self.ranks]))
        return {p: np.array([self.ranks[d]] if d in self.ranks else next(trees), "<u4").tobytes()
                for p, d in zip(pieces, data, strict=True)}

    def encoded(self, texts: list[str]) -> list[bytes]:
        """The ids of every text; texts are taken some ``AT_ONCE`` characters at a time."""
        out, cuts, size = [], [], 0
        for text in texts:
            cuts.append(self.split.findall(text))
            size += len(text)
            if size >= AT_ONCE:
                out += self._joined_cuts(cuts)
                cuts, size = [], 0
        return out + self._joined_cuts(cuts)

    def _joined_cuts(self, cuts: list[list[str]]) -> list[bytes]:
        pieces = set(chain.from_iterable(cuts))
        fresh = self.encoded_pieces([p for p in pieces if p not in self.known])
        ids_of = {p: self.known[p] for p in pieces if p in self.known} | fresh
        if len(self.known) + len(fresh) > KNOWN:
            self.known = {}
        self.known.update((p, ids) for p, ids in fresh.items() if len(p) <= SHORT)
        return [b"".join(map(ids_of.__getitem__, cut)) for cut in cuts]

    def decoded(self, ids: list[int]) -> bytes:
        """The tokens' bytes, concatenated up the tree."""
        if len(ids) <= BRANCH:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decoded(ids[:half]) + self.decoded(ids[half:])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> ByteEncoder:
    return ByteEncoder(path, pattern)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for every row; no shuffle, no other column is read.

    ``ids`` are little-endian unsigned 32-bit integers in one binary value; special strings inside texts
    are ordinary text. ``decoded`` holds the bytes of the ids. Null and empty texts have no ids.
    Repeated rows are alike. An empty table gives no rows. ``path``: a rank file that every executor has.
    """
    path = path or public_tokenizers.path(MODEL)

    def work(batches):
        own = encoder(path, pattern)
        for batch in batches:
            ids = own.encoded([t.as_py() or "" for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()),
                pa.array([own.decoded(np.frombuffer(i, "<u4").tolist()) for i in ids], pa.binary())], schema=ENCODED)
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.mapInArrow(work, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")


def encoded_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
