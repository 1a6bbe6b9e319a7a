"""Blocks of documents that ask a distributed table for what they need.

Some operators need a fact about every word or phrase of a text, kept in a table that grows with the
corpus. Moving one row per word would move the corpus many times over, so documents are read in
blocks of bounded size: a block asks each bucket of the table once, with its distinct keys in one
compressed row; the bucket answers every block that asked; and the answers meet the block again.

The texts are read anew for each step, so the input must come back in the same order and cut, as a
stored table does. Every row carries a digest of its block's content, and a step that finds another
content fails instead of mixing blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20    # a block takes some twenty to thirty times its size in its task
BUCKETS = 256            # raise with the corpus: a bucket's distinct keys should fit a task
NO_ID = np.iinfo(np.int64).max

ASKED = "bucket int, block bigint, digest bigint, payload binary"
_NAMES = ["bucket", "block", "digest", "payload"]


def squeeze(*parts: bytes) -> bytes:
    """Several byte strings as one compressed value."""
    head = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=6).compress(head + b"".join(parts))


def expand(value: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(value)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ends = np.cumsum(np.frombuffer(data, np.int64, n, 8)) + 8 * (n + 1)
    return [data[a:b] for a, b in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist())]


@dataclass
class Block:
    """``ids`` holds ``NO_ID`` for a null id; a null text is an empty one."""
    key: int
    ids: np.ndarray
    texts: list[bytes]

    @property
    def digest(self) -> int:
        """Of ids, lengths and texts, as a signed 64-bit number."""
        h = xxhash.xxh3_64(self.ids.tobytes())
        h.update(np.fromiter(map(len, self.texts), np.int64, len(self.texts)).tobytes())
        for t in self.texts:
            h.update(t)
        return int(np.uint64(h.intdigest()).view(np.int64))

    def pack(self) -> bytes:
        lengths = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        return squeeze(self.ids.tobytes(), lengths.tobytes(), b"".join(self.texts))

    @staticmethod
    def unpack(key: int, value: bytes) -> Block:
        ids, lengths, data = expand(value)
        ends = np.cumsum(np.frombuffer(lengths, np.int64)).tolist()
        return Block(key, np.frombuffer(ids, np.int64), [data[a:b] for a, b in zip([0, *ends[:-1]], ends)])

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.ids == NO_ID)


def read_blocks(batches: Iterable[pa.RecordBatch], block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Whole documents, in order, until a block holds ``block_bytes``; a longer text is a block alone."""
    part, number = TaskContext.get().partitionId(), 0
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0

    def made() -> Block:
        return Block(part << 32 | number, np.array(ids, np.int64), texts)
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            data = (text or "").encode()
            if texts and size + len(data) > block_bytes:
                yield made()
                number, ids, texts, size = number + 1, [], [], 0
            ids.append(NO_ID if doc_id is None else doc_id)
            texts.append(data)
            size += len(data)
    if texts:
        yield made()


def documents_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ask(docs: DataFrame, question: Callable[[Block], Iterable[tuple[int, bytes]]], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block and bucket, as ``ASKED``; ``docs`` is ``doc_id, text``."""
    def asked(batches):
        for block in read_blocks(batches, block_bytes):
            rows, digest = list(question(block)), block.digest
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in rows], pa.int32()), pa.array([block.key] * len(rows), pa.int64()),
                     pa.array([digest] * len(rows), pa.int64()), pa.array([p for _, p in rows], pa.binary())], _NAMES)
    return docs.mapInArrow(asked, ASKED)


def answer(asked: DataFrame, reply: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """The reply to every question of ``asked``; a bucket's questions meet in one task, one bucket at a time."""
    def answered(batches):
        rows: list[tuple] = []

        def replied():
            values = reply([r[3] for r in rows])
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int64()), pa.array(values, pa.binary())], _NAMES)
        for batch in batches:
            for row in zip(*(batch[n].to_pylist() for n in _NAMES), strict=True):
                if rows and rows[0][0] != row[0]:
                    yield replied()
                    rows = []
                rows.append(row)
        if rows:
            yield replied()
    return (asked.repartition(parallelism(asked), "bucket").sortWithinPartitions("bucket", "block")
            .mapInArrow(answered, ASKED))


def meet(docs: DataFrame, answers: DataFrame, work: Callable[[Block, dict[int, bytes]], pa.Table], schema: str,
         empty: pa.Schema, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``work`` on every block with the answers to it by bucket; blocks must be cut as for :func:`ask`."""
    def packed(batches):
        for block in read_blocks(batches, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([block.key], pa.int64()), pa.array([block.digest], pa.int64()),
                                              pa.array([block.pack()], pa.binary())], ["block", "digest", "payload"])

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1 or any(d != left["digest"][0].as_py() for d in right["digest"].to_pylist()):
            raise RuntimeError("the documents came back in another order: store them before this step")
        block = Block.unpack(left["block"][0].as_py(), left["payload"][0].as_py())
        return work(block, dict(zip(right["bucket"].to_pylist(), right["payload"].to_pylist(), strict=True))).cast(empty)
    n = parallelism(docs)
    blocks = docs.mapInArrow(packed, "block bigint, digest bigint, payload binary").repartition(n, "block")
    return blocks.groupBy("block").cogroup(answers.repartition(n, "block").groupBy("block")).applyInArrow(met, schema)
