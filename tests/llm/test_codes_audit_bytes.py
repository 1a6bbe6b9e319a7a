"""Vector codes, filter audit and byte-level BPE against brute force, the library and SQL."""

import base64
import hashlib
import math
import random
from itertools import permutations
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from fieldwatch.llm import byte_bpe, filter_audit, registry, vector_codes
from fieldwatch.llm.common import ready

from .cases import EXTRA, ODD, documents, frame
from .test_operators import key, rows_of, sha, words

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")
VECTORS = "vec_id bigint, embedding array<float>, label int"


def extra(df):
    for name in (*EXTRA, "v", "code", "error", "part", "mask", "good", "id", "digest"):
        df = df.withColumn(name, F.lit(f"mine {name}"))
    return df


# --- vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(x * 1024) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    dims = max(-(-max(len(v) for _, v, _ in kept) // parts), 1) * parts
    kept = [(i, v + [0] * (dims - len(v)), label) for i, v, label in kept]
    w = dims // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            owned = {}
            for c in cut:
                owned.setdefault(near(c[p], books[p])[1], []).append(c[p])
            for n, xs in owned.items():
                books[p][n] = [sum(col) // len(xs) for col in zip(*xs)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = sha(",".join(str(x) for book in books for e in book for x in e))
    return sorted([(i, "".join(f"{n:02x}" for _, n in f), min(e, 2 ** 63 - 1), min(by_label[label], 2 ** 63 - 1), digest)
                   for (i, _, label), f, e in zip(kept, found, errors)], key=key)


def vectors(spark, rows):
    return extra(spark.createDataFrame(rows, VECTORS).repartition(3))


def test_vector_codes_equal_a_full_search(spark):
    ready(spark)
    draw = random.Random(5)
    rows = [(i, [round(draw.gauss(0, 2), 1) for _ in range(8)], draw.choice([0, 1, 1, 1, None])) for i in range(700)]
    rows += [(900 + i, [0.5, -0.25] * 4, 1) for i in range(300)]                       # one very common vector
    rows += [(7, rows[7][1], 0), (7, [9.0] * 8, 0), (None, [1.0] * 8, None), (None, None, 2)]
    rows += [(5000, [1.0, float("nan")] + [0.0] * 6, 3), (5001, [float("inf")] * 8, 3), (5002, [None] * 8, 3), (5003, None, 3),
             (5004, [], 4), (5005, [3.0], 4)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert rows_of(vector_codes.code_table(vectors(spark, rows))) == brute_codes(rows)


@pytest.mark.parametrize("scale", [1e6, 3e9, 1e30])
def test_vector_codes_of_large_numbers_are_exact(spark, scale):
    ready(spark)
    draw = random.Random(int(math.log10(scale)))
    rows = [(i, [float(np.float32(draw.choice([1.0, scale, -scale]) * draw.random())) for _ in range(8)], 0) for i in range(60)]
    df = spark.createDataFrame(rows, VECTORS)
    coded, books = vector_codes.compress(df, entries=16)
    want = brute_codes(rows, entries=16)
    assert sorted((r[0], r[2].hex(), r[3]) for r in coded.collect()) == [w[:3] for w in want]
    assert vector_codes.codebook_digest(books) == want[0][4]


def test_vector_codes_of_an_empty_table(spark):
    ready(spark)
    assert rows_of(vector_codes.code_table(vectors(spark, [(1, None, 1), (2, [float("nan")], 1)]))) == []
    assert rows_of(vector_codes.code_table(vectors(spark, []))) == []


def test_tree_finds_the_lowest_of_the_nearest_and_drops_subtrees():
    draw = np.random.default_rng(3)
    entries = draw.integers(-4, 5, (256, 3)).astype(float)     # many equal entries and equal distances
    queries = draw.integers(-6, 7, (2000, 3)).astype(float)
    number, square = vector_codes.EntryTree(entries).nearest(queries)
    full = vector_codes.squared(queries, entries)
    assert (number == full.argmin(axis=1)).all() and (square == full.min(axis=1)).all()
    centres = draw.integers(-5000, 5000, (16, 8))
    entries = (np.repeat(centres, 16, axis=0) + draw.integers(-9, 10, (256, 8))).astype(float)
    tree, looked = vector_codes.EntryTree(entries), []
    search = tree._search
    tree._search = lambda node, q, rows, *rest: (looked.append(len(rows) * len(node.points)), search(node, q, rows, *rest))
    queries = entries[draw.integers(0, 256, 500)] + draw.integers(-5, 6, (500, 8))
    assert (tree.nearest(queries)[0] == vector_codes.squared(queries, entries).argmin(axis=1)).all()
    assert sum(looked) < 500 * 256 / 3


# --- filter audit


def brute_audit(rows, labels):
    marks = {}
    for i, quality, toxic in labels:
        if i is not None:
            good, bad = marks.get(i, (False, False))
            marks[i] = (good or quality == 1, bad or toxic == 1)
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    judged = {}
    for i, text, lang, *_ in rows:
        text, w = text or "", words(text)
        fails = {f for f, failed in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            any(c in "#$%&*|" for c in text), text in first and (i is None or i > first[text]))) if failed}
        judged.setdefault(lang or "", []).append((fails, *marks.get(i, (False, False))))
    out = []
    for part, docs in judged.items():
        removals, steps = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                removals[f] += len(gone)
                steps.append((part, order, k + 1, f, len(left), len(gone), sum(f in d[0] for d in docs) - len(gone),
                              sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(*s[:3], *s[4:], removals[s[3]]) for s in steps]
    return sorted(out, key=key)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit("mine"))


def test_audit_equals_applying_every_order(spark):
    ready(spark)
    long = " ".join(f"word{i}" for i in range(260))
    rows = documents() + [(700 + k, long + tail, lang, None, None) for k, (tail, lang) in enumerate(
        [("", "en"), ("", "fr"), (" #", "en"), (" AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA", None), (long, "fr")])]
    rows += [(None, long, "en", None, None), (700, long, "en", None, None)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 800, 3)] + [(3, 1, 1), (3, 0, 0), (700, None, None), (None, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    got = filter_audit.audit_filters(frame(spark, rows), labelled(spark, labels))
    assert rows_of(got) == brute_audit(rows, labels)


def test_audit_of_empty_tables(spark):
    ready(spark)
    assert rows_of(filter_audit.audit_filters(frame(spark, []), labelled(spark, [(1, 1, 1)]))) == []
    rows = [(1, None, None, None, None)]
    assert rows_of(filter_audit.audit_filters(frame(spark, rows), labelled(spark, []))) == brute_audit(rows, [])


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 20])
def test_transducer_carries_its_state_across_blocks(block):
    for text in [t for t in ODD if t] + ["aa AA aa A|A aa", "end ", " x", "é É é"]:
        w = words(text)
        assert filter_audit.text_counts(text.encode(), block) == (
            len(w), len(set(w)), sum("A" <= c <= "Z" for c in text), len(text), sum(c in "#$%&*|" for c in text))


# --- byte-level BPE


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(byte_bpe.MODEL), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return byte_bpe.encoder(public_tokenizers.path(byte_bpe.MODEL))


def ids_of(own, text):
    return np.frombuffer(own.encoded([text])[0], "<u4").tolist()


def test_byte_bpe_equals_the_library(spark, library):
    ready(spark)
    rows = documents()
    want = []
    for i, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())))
    got = byte_bpe.encoded_digests(byte_bpe.encode_documents(frame(spark, rows)))
    assert rows_of(got) == sorted(want, key=key)
    assert rows_of(byte_bpe.encoded_digests(byte_bpe.encode_documents(frame(spark, [])))) == []


def test_byte_bpe_of_drawn_texts(own, library):
    draw = random.Random(11)
    for alphabet in ("ab", "aab ", "abcdefgh", "日本語", "éèß ", "xyz0123 \n", "😀👩‍👧 ", "aeiou th", " \t\x85\xa0\x1c"):
        for _ in range(60):
            text = "".join(draw.choices(alphabet, k=draw.randint(0, 400)))
            ids = ids_of(own, text)
            assert ids == library.encode_ordinary(text)
            assert own.decoded(ids) == text.encode()
    for text in ("x" * 5000, "ab" * 3000, "日本" * 2000, " " * 9999 + "a"):
        assert ids_of(own, text) == library.encode_ordinary(text)


def test_joined_ids_do_not_depend_on_the_cut(own):
    draw = random.Random(2)
    for alphabet in (b"ab", b"the qu", bytes(range(256))):
        for _ in range(120):
            data = bytes(draw.choices(alphabet, k=draw.randint(2, 90)))
            whole, at = own.merged(data), draw.randint(1, len(data) - 1)
            assert own._merged_by_heap(data) == whole
            assert own.joined(own.merged(data[:at]), own.merged(data[at:])) == whole
            assert own.reduced([data]) == [whole]


def test_remembered_pieces_are_bounded(own, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KNOWN", 50)
    texts = [" ".join(f"piece{i}x{k}" for i in range(40)) for k in range(5)]
    fresh = byte_bpe.ByteEncoder(public_tokenizers.path(byte_bpe.MODEL))
    assert [fresh.encoded([t])[0] for t in texts] == own.encoded(texts)
    assert len(fresh.known) <= 250


@needs_data
@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_filter_audit"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    cursor = con.execute(registry.SQL[name])
    at = [[d[0] for d in cursor.description].index(c) for c in got.columns]
    assert rows_of(got) == sorted([tuple(r[k] for k in at) for r in cursor.fetchall()], key=key)


@needs_data
def test_byte_bpe_over_the_whole_table(spark, library):
    want = []
    for i, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), hashlib.sha256((text or "").encode()).hexdigest()))
    assert rows_of(registry.op13_byte_bpe(spark, SF)) == sorted(want, key=key)
