"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens. The distinct pre-tokens of a batch lie one after another in a ragged
numpy array of symbols; in each step every sequence merges all places of its own lowest-rank pair at
once, and a sequence is done when no pair of it has a rank. The symbols left are its tokens. A merge
only makes pairs of higher rank than its own, so merging all places of the lowest pair together gives
what merging them one at a time would.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "byte_bpe_50k.json"
LIMIT = 512
KNOWN = 200_000     # pre-tokens whose counts a worker remembers
#: White space as the tokenizer's pattern means it (Unicode White_Space), stated in full.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else 256 and on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = [""] * 256
    for b in plain:
        out[b] = chr(b)
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[b] = chr(256 + n)
    return out


class RankMerger:
    """Counts the tokens of byte strings under one merge list."""

    def __init__(self, path: str):
        model = json.loads(open(path, encoding="utf-8").read())
        if model["normalizer"] is not None or model["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("not a plain byte-level model")
        vocab = model["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.never = len(merges)
        self.start = np.array([vocab[s] for s in byte_symbols()], np.int64)
        self.special = [t["content"] for t in model["added_tokens"]]
        self.split = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], self.never)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of every non-empty byte string."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = lengths.copy()
        ids = self.start[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        ranks = np.full(len(ids), self.never, np.int64)   # of the pair that starts at each symbol
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[inner] = self.pair_ranks(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            best = np.minimum.reduceat(ranks, starts)
            active = best < self.never
            out[owner[starts[~active]]] = sizes[~active]
            stay = np.repeat(active, sizes)
            if not active.any():
                break
            ids, owner, ranks = ids[stay], owner[stay], ranks[stay]
            low = np.repeat(best[active], sizes[active])
            hit = np.flatnonzero(ranks == low)
            # places one after another overlap (a pair of one symbol twice): every other one merges
            run = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))) % 2 == 0]
            ids[hit] = self.made[ranks[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            ids, owner, ranks = ids[keep], owner[keep], ranks[keep]
            mark = np.zeros(len(ids) + 1, bool)   # the last entry takes what lies before the first symbol
            mark[place[hit]] = mark[place[hit] - 1] = True
            touched = np.flatnonzero(mark[:-1])
            ranks[touched] = self.never
            inner = touched[touched < len(ids) - 1]
            inner = inner[owner[inner] == owner[inner + 1]]
            ranks[inner] = self.pair_ranks(ids[inner], ids[inner + 1])
        return out

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text and how many special tokens stand in it."""
        special, parts = 0, [text]
        for mark in self.special:
            cut = [piece for part in parts for piece in part.split(mark)]
            special += len(cut) - len(parts)
            parts = cut
        return [t for part in parts for t in self.split.findall(part)], special

    def count_texts(self, texts: list[str]) -> list[int]:
        cut = [self.pre_tokens(t) for t in texts]
        known = self.known
        new = list({t for tokens, _ in cut for t in tokens if t not in known})
        fresh = dict(zip(new, self.counts([t.encode() for t in new]).tolist(), strict=True)) if new else {}
        if len(known) + len(fresh) > KNOWN:
            known = {t: known[t] for tokens, _ in cut for t in tokens if t in known}
            self.known = {}
        known.update(fresh)
        if len(known) <= KNOWN:
            self.known = known
        return [sum(map(known.__getitem__, tokens)) + special for tokens, special in cut]


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def token_count_column(text: Column, path: str) -> Column:
    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array(merger(path).count_texts([t.as_py() or "" for t in texts]), pa.int64())
    return counted(text.cast("string"))


def count_tokens(docs: DataFrame, limit: int = LIMIT, path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; no shuffle, no other column is read.

    Null and empty texts have no tokens. Special strings inside a text count as one token, as the
    tokenizer's default has it. Repeated rows are alike. An empty table gives no rows. ``path``: a
    byte-level model file that every executor has.
    """
    text = F.col(f"`{text_col}`")
    counted = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"),
                          token_count_column(text, path or public_tokenizers.path(MODEL)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
