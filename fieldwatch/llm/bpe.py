"""BPE encoding and decoding through a table of distinct words.

Texts are split into words at white space in Spark, and each distinct word of the corpus is encoded
once, in the bucket it hashes to; a word's ids go back to every block of documents that holds it and
are joined by position. Decoding joins the ids with the vocabulary's id-to-piece table, whose size
is fixed by the vocabulary, once per distinct word of a block.

Splitting first gives what the library gives on whole texts: the model's normalizer and pre-tokenizer
act on no more than the text between white space, which they drop, and its special strings hold none.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .blocks import BUCKETS, Block, answer, ask, documents_of, expand, meet, squeeze

MODEL = "word_bpe_49k.json"
AT_ONCE = 1024   # words handed to the library at once; its results are large
ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark spreads the work
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def word_split_is_safe(path: str) -> bool:
    """Whether the model file drops white space and keeps no context across it."""
    model = json.loads(open(path, encoding="utf-8").read())
    steps = (model.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return steps[0].get("type") == "Split" and steps[0].get("invert") is True and not model.get("decoder")


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """The id-to-piece table."""
    t = tokenizer(path)
    return [(t.id_to_token(i) or "").encode() for i in range(t.get_vocab_size(with_added_tokens=True))]


def words_by_bucket(block: Block, buckets: int) -> list[list[bytes]]:
    """The block's distinct words, sorted within each bucket."""
    distinct: set[bytes] = set()
    for text in block.texts:
        distinct.update(text.split())   # at [\x20\x09-\x0D], as all bytes methods do
    out: list[list[bytes]] = [[] for _ in range(buckets)]
    for word in distinct:
        out[zlib.crc32(word) % buckets].append(word)
    for words in out:
        words.sort()
    return out


def encode_words(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and all ids in order."""
    counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for at in range(0, len(words), AT_ONCE):
        encodings = [e.ids for e in tokenizer(path).encode_batch([w.decode() for w in words[at:at + AT_ONCE]], add_special_tokens=False)]
        counts.append(np.fromiter(map(len, encodings), np.int64, len(encodings)))
        ids.append(np.array([i for e in encodings for i in e], np.uint32))
    return np.concatenate(counts), np.concatenate(ids)


def encode_documents(docs: DataFrame, path: str | None = None, buckets: int = BUCKETS, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for every row.

    ``ids`` are little-endian unsigned 32-bit integers in one binary value, as the library encodes the
    whole text without added special tokens; ``decoded`` is its decoding with special tokens kept. A
    null text counts as empty and has no ids. Repeated rows are alike; an empty table gives no rows;
    other columns are not read. ``path``: a model file that every executor has.
    """
    path = path or public_tokenizers.path(MODEL)
    if not word_split_is_safe(path):
        raise ValueError("this model keeps context across white space, so words cannot be encoded alone")

    def question(block: Block):
        for bucket, words in enumerate(words_by_bucket(block, buckets)):
            if words:
                yield bucket, squeeze(b" ".join(words))

    def reply(questions: list[bytes]) -> list[bytes]:
        asked = [expand(q)[0].split() for q in questions]
        table = sorted({w for words in asked for w in words})
        counts, ids = encode_words(table, path)
        place = dict(zip(table, range(len(table)), strict=True))
        starts = np.cumsum(counts) - counts
        out = []
        for words in asked:
            rows = np.fromiter((place[w] for w in words), np.int64, len(words))
            n = counts[rows]
            at = np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append(squeeze(n.astype(np.uint32).tobytes(), ids[at].tobytes()))
        return out

    def work(block: Block, answers: dict[int, bytes]) -> pa.Table:
        table, ids_of, text_of = pieces(path), {}, {}
        for bucket, words in enumerate(words_by_bucket(block, buckets)):
            if words:
                counts, ids = expand(answers[bucket])
                ends = np.cumsum(np.frombuffer(counts, np.uint32).astype(np.int64)).tolist()
                numbers = np.frombuffer(ids, np.uint32).tolist()
                for word, a, b in zip(words, [0, *ends[:-1]], ends, strict=True):
                    ids_of[word] = ids[4 * a:4 * b]
                    text_of[word] = b" ".join([table[i] for i in numbers[a:b]])
        del answers
        encoded, decoded = [], []
        for text in block.texts:
            words = text.split()
            encoded.append(b"".join(map(ids_of.__getitem__, words)))
            decoded.append(b" ".join(filter(None, map(text_of.__getitem__, words))))
        return pa.table([block.id_array(), pa.array([len(e) // 4 for e in encoded], pa.int64()), pa.array(encoded, pa.binary()),
                         pa.array(decoded, pa.binary()).cast(pa.string())], schema=ENCODED)
    texts = documents_of(docs, id_col, text_col)
    return meet(texts, answer(ask(texts, question), reply), work, "doc_id bigint, n_tokens bigint, ids binary, decoded string", ENCODED)


def encoded_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
