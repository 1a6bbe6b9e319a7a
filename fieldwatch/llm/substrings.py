"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over every text names triggers: in each string of ``LENGTH`` bytes, the ``WINDOW``-byte
string of the smallest hash (the rightmost, if several). Triggers cut a text into phrases, one for
each run of strings with the same trigger, each reaching ``LENGTH - 1`` bytes into the next, so that
every string starts in exactly one phrase. Equal strings have the same trigger wherever they stand.

* Dictionary: the distinct phrases whose trigger stands in more than one document.
* Parse: the phrases of each document in order, with its id.

Buckets are named by trigger, so all equal strings of the corpus meet in one bucket. There the suffix
array of the dictionary (suffixes compared over ``LENGTH`` bytes, all that matters here) brings equal
strings side by side, and combined with the parse it gives the smallest document of each: corpus
order without ever sorting the corpus. A phrase stands in the dictionary once however often the
corpus repeats it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NO_ID, Block, answer, ask, documents_of, expand, meet, squeeze

LENGTH = 50
WINDOW = 20
BUCKETS = 256      # named by the highest bits of a trigger's hash: a power of two, 256 or more in production
GROUP_BYTES = 1 << 18
REMOVED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()),
                     ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def rolling_hash(data: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of the ``width`` bytes from each place on; doubles the width step by step."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    base, levels = 0xD6E8FEB86659FD93, []
    step = 1
    while step <= width:
        levels.append((h, step, base))
        h = h[:len(h) - step] * np.uint64(base) + h[step:]
        base, step = base * base % 2**64, 2 * step
    out, used = None, 0
    for level, size, power in reversed(levels):
        if width & size:
            if out is None:
                out = level
            else:
                n = len(data) - used - size + 1
                out = out[:n] * np.uint64(power) + level[used:used + n]
            used += size
    out = out[:len(data) - width + 1] * np.uint64(0xFF51AFD7ED558CCD)
    return out ^ out >> np.uint64(32)


def spread(hashes: np.ndarray) -> np.ndarray:
    """Triggers are the smallest hashes of their strings; mixed again, they fill all buckets alike."""
    hashes = (hashes ^ hashes >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return hashes ^ hashes >> np.uint64(29)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    out, size = values, 1
    while 2 * size <= width:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - size:width - size + n])


class Phrases:
    """The phrases of a block: document, first byte, length, spread trigger hash and the trigger's offset."""

    def __init__(self, block: Block, length: int = LENGTH, window: int = WINDOW):
        found: list[tuple[np.ndarray, ...]] = []
        group: list[int] = []
        size = base = 0
        for i, text in enumerate([*block.texts, b""]):
            last = i == len(block.texts)
            if group and (last or size + len(text) > GROUP_BYTES):
                found.append(self._parse(block, group, base, length, window))
                base += size
                group, size = [], 0
            if not last:
                group.append(i)
                size += len(text)
        fields = [np.concatenate(f) for f in zip(*found)] if found else [np.zeros(0, np.int64)] * 5
        self.doc, self.start, self.size, self.hash, self.offset = fields
        self.hash = spread(self.hash.astype(np.uint64))

    @staticmethod
    def _parse(block, group, base, length, window):
        lengths = np.fromiter((len(block.texts[i]) for i in group), np.int64, len(group))
        data = np.frombuffer(b"".join(block.texts[i] for i in group), np.uint8)
        if len(data) < length:
            return (np.zeros(0, np.int64),) * 5
        ends = np.cumsum(lengths)
        hashes = rolling_hash(data, window)
        places = np.arange(len(hashes), dtype=np.uint64)
        low = np.uint64(0xFFFFFFFF)
        least = sliding_least(hashes & ~low | low - places, length - window + 1)
        trigger = (low - (least & low)).astype(np.int64)
        # strings inside one document; those of a document lie side by side
        count = np.maximum(lengths - length + 1, 0)
        doc = np.repeat(np.arange(len(group)), count)
        at = np.repeat(ends - lengths - (np.cumsum(count) - count), count) + np.arange(count.sum())
        trigger = trigger[at]
        first = np.flatnonzero(np.r_[True, (trigger[1:] != trigger[:-1]) | (doc[1:] != doc[:-1])]) if len(at) else np.zeros(0, np.int64)
        many = np.diff(np.r_[first, len(at)])
        start = at[first]
        return (np.array(group, np.int64)[doc[first]], start + base, many + length - 1, hashes[trigger[first]].view(np.int64),
                trigger[first] - start)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)


def _keys(hashes: np.ndarray) -> np.ndarray:
    """48 bits of a trigger's hash decide who asks for it; a clash only makes a phrase travel in vain."""
    return hashes >> np.uint64(16)


def _edges(sorted_values: np.ndarray, n: int) -> list[int]:
    return np.searchsorted(sorted_values, np.arange(n + 1)).tolist()


class Triggers:
    """A block's distinct trigger keys in order, and which of them two of its documents share."""

    def __init__(self, phrases: Phrases, buckets: int):
        key = _keys(phrases.hash)
        order = np.lexsort((phrases.doc, key))
        k, d = key[order], phrases.doc[order]
        new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
        self.keys = k[new]
        starts = np.flatnonzero(new)
        self.shared = d[starts] != d[np.r_[starts[1:], len(d)] - 1] if len(k) else np.zeros(0, bool)
        self.of_phrase = np.empty(len(k), np.int64)
        self.of_phrase[order] = np.cumsum(new) - 1
        self.edges = _edges(_bucket(self.keys << np.uint64(16), buckets), buckets)


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, buckets: int = BUCKETS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for every row.

    ``spans`` are the maximal runs of bytes covered by a ``length``-byte string that also starts in a
    document with a smaller id; ``kept`` is the rest. Strings are judged on the input and never cross
    documents. A null text is empty; a null id counts as larger than all others, and rows of equal ids
    (null too) take nothing from each other. Shorter texts are kept whole. An empty table gives no rows.
    Other columns are not read.
    """
    def triggers_asked(block: Block):
        t = Triggers(Phrases(block, length, window), buckets)
        for bucket, (a, b) in enumerate(zip(t.edges, t.edges[1:])):
            if a < b:
                keys = np.ascontiguousarray(t.keys[a:b].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
                yield bucket, squeeze(keys.tobytes(), np.packbits(t.shared[a:b]).tobytes())

    def triggers_shared(questions: list[bytes]) -> list[bytes]:
        keys, shared = [], []
        for q in questions:
            k, s = expand(q)
            k = np.frombuffer(k, np.uint8).reshape(-1, 6)
            keys.append(np.pad(k, ((0, 0), (0, 2))).view("<u8").ravel())
            shared.append(np.unpackbits(np.frombuffer(s, np.uint8), count=len(k)).astype(bool))
        _, place, many = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        wide = many > 1
        np.logical_or.at(wide, place[np.concatenate(shared)], True)
        flags, out, a = wide[place], [], 0
        for k in keys:
            out.append(squeeze(np.packbits(flags[a:a + len(k)]).tobytes()))
            a += len(k)
        return out

    def chosen(block: Block, flags: dict[int, bytes]):
        """The block's phrases with a shared trigger: their rows and, by bucket, the distinct ones in order."""
        p = Phrases(block, length, window)
        t = Triggers(p, buckets)
        wide = np.zeros(len(t.keys), bool)
        for bucket, (a, b) in enumerate(zip(t.edges, t.edges[1:])):
            if a < b:
                wide[a:b] = np.unpackbits(np.frombuffer(flags[bucket], np.uint8), count=b - a)
        rows = np.flatnonzero(wide[t.of_phrase])
        data = b"".join(block.texts)
        strings = [data[a:a + n] for a, n in zip(p.start[rows].tolist(), p.size[rows].tolist())]
        return p, rows, strings, _bucket(p.hash[rows], buckets).tolist()

    def phrases_asked(block: Block, answers: dict[int, bytes]) -> pa.Table:
        flags = {b: expand(v)[0] for b, v in answers.items()}
        p, rows, strings, bucket_of = chosen(block, flags)
        least: list[dict[bytes, tuple[int, int]]] = [{} for _ in range(buckets)]
        for s, b, d, o in zip(strings, bucket_of, block.ids[p.doc[rows]].tolist(), p.offset[rows].tolist()):
            had = least[b].get(s)
            if had is None or d < had[0]:
                least[b][s] = (d, o)
        out = []
        for b in sorted(flags):
            known = sorted(least[b])
            if known:
                out.append((b, squeeze(flags[b], np.fromiter(map(len, known), np.uint8, len(known)).tobytes(),
                                       np.array([least[b][s][1] for s in known], np.uint8).tobytes(),
                                       np.array([least[b][s][0] for s in known], np.int64).tobytes(), b"".join(known))))
            else:
                out.append((b, squeeze(flags[b], b"", b"", b"", b"")))
        digest = block.digest
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "block": pa.array([block.key] * len(out), pa.int64()),
                         "digest": pa.array([digest] * len(out), pa.int64()), "payload": pa.array([v for _, v in out], pa.binary())})

    def smallest_documents(questions: list[bytes]) -> list[bytes]:
        asked, least, trigger_of = [], {}, {}
        for q in questions:
            flags, sizes, offsets, ids, data = expand(q)
            sizes, offsets = np.frombuffer(sizes, np.uint8).tolist(), np.frombuffer(offsets, np.uint8).tolist()
            strings, at = [], 0
            for n, o, d in zip(sizes, offsets, np.frombuffer(ids, np.int64).tolist()):
                s = data[at:at + n]
                at += n
                strings.append(s)
                if d < least.get(s, NO_ID + 1):
                    least[s] = d
                    trigger_of[s] = s[o:o + window]
            asked.append((flags, strings))
        variants: dict[bytes, int] = {}
        for t in trigger_of.values():
            variants[t] = variants.get(t, 0) + 1
        # a phrase without another of its trigger has no string in common with the rest of the dictionary
        several = [s for s, t in trigger_of.items() if variants[t] > 1]
        ids_of = {}
        if several:
            ids = np.fromiter((least[s] for s in several), np.int64, len(several))
            sizes = np.fromiter(map(len, several), np.int64, len(several))
            count = sizes - length + 1
            starts = np.cumsum(sizes) - sizes
            base = np.cumsum(count) - count
            at = np.repeat(starts - base, count) + np.arange(count.sum())
            data = np.frombuffer(b"".join(several), np.uint8)
            suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[at]).view(f"S{length}").ravel()
            order = np.argsort(suffixes, kind="stable")   # the suffix array of the dictionary
            ordered = suffixes[order]
            first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            owner = np.repeat(ids, count)
            smallest = np.empty(len(at), np.int64)
            smallest[order] = np.repeat(np.minimum.reduceat(owner[order], first), np.diff(np.r_[first, len(at)]))
            ids_of = {s: smallest[b:b + n] for s, b, n in zip(several, base.tolist(), count.tolist())}
        out = []
        for flags, strings in asked:
            varied = np.fromiter((s in ids_of for s in strings), bool, len(strings))
            each = [ids_of[s] for s in strings if s in ids_of]
            out.append(squeeze(flags, np.packbits(varied).tobytes(),
                               np.array([least[s] for s in strings if s not in ids_of], np.int64).tobytes(),
                               np.concatenate(each).tobytes() if each else b""))
        return out

    def cut(block: Block, answers: dict[int, bytes]) -> pa.Table:
        got = {b: expand(v) for b, v in answers.items()}
        p, rows, strings, bucket_of = chosen(block, {b: v[0] for b, v in got.items()})
        known: list[set[bytes]] = [set() for _ in range(buckets)]
        for s, b in zip(strings, bucket_of):
            known[b].add(s)
        place: dict[bytes, int] = {}    # where a phrase's smallest documents begin in `smallest`
        parts, total = [np.zeros(0, np.int64)], 0
        for b, (_, varied, same, each) in got.items():
            names = sorted(known[b])
            flags = np.unpackbits(np.frombuffer(varied, np.uint8), count=len(names)).astype(bool)
            count = np.fromiter(map(len, names), np.int64, len(names)) - length + 1
            value = np.empty(count.sum(), np.int64)
            inside = np.repeat(flags, count)
            value[inside] = np.frombuffer(each, np.int64)
            value[~inside] = np.repeat(np.frombuffer(same, np.int64), count[~flags])
            place.update(zip(names, (np.cumsum(count) - count + total).tolist()))
            parts.append(value)
            total += len(value)
        smallest = np.concatenate(parts)
        count = p.size[rows] - length + 1
        begin = np.fromiter((place[s] for s in strings), np.int64, len(strings))
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        repeated = smallest[np.repeat(begin, count) + step] < np.repeat(block.ids[p.doc[rows]], count)
        at = (np.repeat(p.start[rows], count) + step)[repeated]
        del strings, known, place, parts, smallest, begin, step, repeated
        lengths = np.fromiter(map(len, block.texts), np.int64, len(block.texts))
        change = np.zeros(lengths.sum() + 1, np.int32)
        np.add.at(change, at, 1)
        np.add.at(change, at + length, -1)
        covered = np.cumsum(change[:-1], dtype=np.int32) > 0
        ends = np.cumsum(lengths)
        spans, kept = [], []
        for text, a, b in zip(block.texts, (ends - lengths).tolist(), ends.tolist()):
            marks = covered[a:b]
            if not marks.any():
                spans.append([])
                kept.append(text)
                continue
            turn = np.flatnonzero(np.diff(np.r_[False, marks, False].astype(np.int8)))
            spans.append([{"start": x, "end": y} for x, y in turn.reshape(-1, 2).tolist()])
            kept.append(np.frombuffer(text, np.uint8)[~marks].tobytes())
        return pa.table([block.id_array(), pa.array(lengths, pa.int64()), pa.array(spans, REMOVED.field("spans").type),
                         pa.array(kept, pa.binary())], schema=REMOVED)

    if buckets & (buckets - 1) or buckets < 2:
        raise ValueError("buckets must be a power of two")
    texts = documents_of(docs, id_col, text_col)
    flags = answer(ask(texts, triggers_asked), triggers_shared)
    phrases = meet(texts, flags, phrases_asked, "bucket int, block bigint, digest bigint, payload binary",
                   pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("digest", pa.int64()), ("payload", pa.binary())]))
    return meet(texts, answer(phrases, smallest_documents), cut,
                "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary", REMOVED)


def removal_digests(removed: DataFrame) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                          F.sha2("kept", 256).alias("kept_sha256"))
