"""Operators against brute force, on a small fixture of odd cases and on the smallest test tables."""

import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldwatch.llm import (bpe, chat, exact_dedup, mixing, quality, registry, sharding, simhash, substrings, token_counts,
                            url_filter)
from fieldwatch.llm.common import ready

from .cases import DOCS, documents, frame

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


def words(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACES:
            out, word = out + [word] * bool(word), ""
        else:
            word += c
    return out + [word] * bool(word)


def split_words(text):
    return (text or "").encode().split()


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def key(row):
    return tuple((v is not None, v) for v in row)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=key)


@pytest.fixture(scope="module")
def docs(spark):
    ready(spark)
    return frame(spark).cache()


@pytest.fixture(scope="module")
def stored(spark):
    ready(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def both(docs, stored):
    return [(docs, [(r["doc_id"], r["text"]) for r in docs.collect()]),
            (stored, [(r["doc_id"], r["text"]) for r in stored.collect()])]


def test_word_means_the_six_spaces():
    for _, text, *_ in documents():
        if text is None or len(text) < 5000:
            assert [w.encode() for w in words(text)] == split_words(text)


# --- 1 --------------------------------------------------------------------------------------
def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x.decode() for x in lowered.encode().split()]
    grams = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=4):
    parent = {p: p for p in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in combinations(sorted(parent), 2):
        if (a ^ b).bit_count() <= distance:
            parent[top(a)] = top(b)
    return {p: top(p) for p in parent}


@needs_data
def test_simhash(docs, stored):
    for df, rows in both(docs, stored):
        prints = [(d, brute_fingerprint(t)) for d, t in rows]
        group = brute_components({p for _, p in prints})
        first = {}
        for d, p in prints:
            g = group[p]
            first[g] = d if first.get(g) is None else first[g] if d is None else min(first[g], d)
        want = sorted([(d, f"{p:016x}", first[group[p]]) for d, p in prints], key=key)
        assert rows_of(simhash.near_duplicates(df)) == want


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_dense_groups_and_chains_lose_no_link(spark, blocks):
    rng = np.random.default_rng(blocks)
    prints, base = set(), [int(x) for x in rng.integers(0, 2**63, 6)]
    for b in base:   # dense balls, chains of steps of up to five bits, and strays
        prints |= {b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(60)}
        walk = b
        for _ in range(40):
            walk ^= sum(1 << int(k) for k in rng.choice(64, rng.integers(3, 6), replace=False))
            prints.add(walk)
    prints |= {int(x) for x in rng.integers(0, 2**63, 200)} | {0, 2**64 - 1, 2**64 - 2}
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    found = {r["fp"]: r["root"] for r in simhash.fingerprint_components(
        spark.createDataFrame(signed, "fp bigint"), blocks).collect()}
    want = brute_components(prints)
    groups, got = defaultdict(set), defaultdict(set)
    for p in prints:
        groups[want[p]].add(p)
        s = p - 2**64 if p >= 2**63 else p
        got[found.get(s, s)].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_components_of_a_long_chain(spark):
    order = np.random.default_rng(3).permutation(300).tolist()
    links = [(order[i], order[i + 1]) for i in range(299)] + [(1000, 1001), (1001, 1000), (1002, 1002)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(300)}, 1000: 1000, 1001: 1000}


# --- 2 --------------------------------------------------------------------------------------
URLS = ["http://WWW.Example.COM/en/x?y#z", "https://example.com/en/", "https://example.com/EN/", "http://a.net/es/1", "http://net/fr/",
        "http://a.net/de/", "http://x.org/", "ftp://a.b.example.com/en/q", "http://notexample.com/en/", "no scheme", "", None, "://",
        "http://", "http://com", "http://com/", "http://a.com?p=/en/", "http://a.com#/x", "x://y://z.com/en/", "http://ÀB.com/ü", "http://.com/",
        "http://example.com:80/en/", "http://a.net/es", "http://www.example.com/en/1", "http://w.www.example.com/en/", "http://a\nb.net/es/\n?x"]


def brute_url(url, rules):
    at = url.find("://") if url is not None else -1
    rest = url[at + 3:] if at >= 0 else ""
    host_end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path_end = min([rest.find(c, host_end) for c in "?#" if rest.find(c, host_end) >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:host_end])
    path = rest[host_end:path_end]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], None), (None, URLS[1], None)],
                                  "page_id bigint, url string, host string")
    want = sorted([(i, *brute_url(u, url_filter.RULES)) for i, u in enumerate(URLS)] + [(0, *brute_url(URLS[0], url_filter.RULES)), (None, *brute_url(URLS[1], url_filter.RULES))], key=key)
    assert rows_of(url_filter.filter_urls(pages)) == want
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, rules=[]).collect()} == {"allow"}


def test_digest_clashes_are_confirmed(tmp_path):
    rng = np.random.default_rng(5)
    rules = [("block" if rng.random() < 0.5 else "allow", f"h{i % 40}.x{i % 7}.com", f"/{'abc'[i % 3] * (i % 4)}") for i in range(200)]
    kept = {}
    for v, h, p in rules:
        kept.setdefault((h, p), v)
    few = lambda k: url_filter.digest(k) % 3   # noqa: E731  three digests for all strings
    url_filter.DigestArray.write(rules, tmp_path, few)
    array = url_filter.DigestArray(lambda file: str(tmp_path / file), few)
    hosts = [f"s.h{i % 45}.x{i % 8}.com" for i in range(300)]
    paths = [f"/{'abc'[i % 3] * (i % 6)}" for i in range(300)]
    want = [brute_url(f"u://{h}{p}", [(v, a, b) for (a, b), v in kept.items()]) for h, p in zip(hosts, paths)]
    assert [(r, v or "allow") for r, v in array.judge(hosts, paths)] == [w[2:] for w in want]


# --- 3, 5 -----------------------------------------------------------------------------------
@needs_data
def test_bpe_is_the_library_on_whole_texts(docs, stored):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for df, rows in both(docs, stored):
        want = []
        for d, t in rows:
            ids = library.encode(t or "", add_special_tokens=False).ids
            want.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False))))
        assert rows_of(bpe.encoded_digests(bpe.encode_documents(df, buckets=16))) == sorted(want, key=key)


def test_bpe_refuses_models_that_need_the_white_space(docs):
    with pytest.raises(ValueError):
        bpe.encode_documents(docs, path=public_tokenizers.path("byte_bpe_50k.json"))


@needs_data
def test_token_counts_are_the_library(docs, stored):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df, rows in both(docs, stored):
        want = []
        for d, t in rows:
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            want.append((d, len((t or "").encode()), n, n > 512))
        assert rows_of(token_counts.count_tokens(df)) == sorted(want, key=key)


def test_splitting_agrees_on_every_character():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    chars = [chr(c) for c in range(0x32000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{x} {x}{y}  {x}1{y}" for x, y in zip(chars[::7], chars[3::7])]
    got = token_counts.merger(public_tokenizers.path("byte_bpe_50k.json")).count_texts(texts)
    assert got == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


# --- 4 --------------------------------------------------------------------------------------
def brute_exact(rows):
    groups = defaultdict(list)
    for n, (d, t) in enumerate(rows):
        bare = "".join(c for c in t or "" if c not in SPACES)
        groups[bare].append((-len(t or ""), d is None, d or 0, n, d))
    return groups


@needs_data
@pytest.mark.parametrize("runs, fan", [(16, 4), (7, 2), (1, 2), (9, 3)])
def test_exact_duplicates(docs, stored, runs, fan):
    for df, rows in both(docs, stored):
        got = [tuple(r) for r in exact_dedup.exact_duplicates(df, runs=runs, fan=fan).collect()]
        want, kept = [], []
        for bare, group in brute_exact(rows).items():
            best = min(group)
            kept.append((best[4], sha(bare)))
            want += [(g[4], best[4], len(group), sha(bare)) for g in group]
        assert sorted([(d, k, n, h) for d, k, n, _, h in got], key=key) == sorted(want, key=key)
        assert sorted([(d, h) for d, k, n, keep, h in got if keep], key=key) == sorted(kept, key=key)


# --- 6 --------------------------------------------------------------------------------------
def brute_repeats(rows, length=50):
    least = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        n = 2**63 - 1 if d is None else d
        for i in range(len(t) - length + 1):
            s = t[i:i + length]
            least[s] = min(n, least.get(s, n))
    out = []
    for d, t in texts:
        n = 2**63 - 1 if d is None else d
        mark = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if least[t[i:i + length]] < n:
                mark[i + 1:i + 1 + length] = True
        turns = int(np.count_nonzero(mark[1:] & ~mark[:-1]))
        out.append((d, len(t), int(mark.sum()), turns, sha(bytes(np.frombuffer(t, np.uint8)[~mark[1:-1]]))))
    return sorted(out, key=key)


@needs_data
def test_repeated_substrings(docs, stored):
    for df, rows in both(docs, stored):
        assert rows_of(substrings.removal_digests(substrings.remove_repeats(df))) == brute_repeats(rows)


@needs_data
def test_triggers_fill_all_buckets_alike(stored):
    texts = [r["text"].encode() for r in stored.collect()]
    phrases = substrings.Phrases(substrings.Block(0, np.arange(len(texts)), texts))
    held = np.bincount(substrings._bucket(phrases.hash, 16), minlength=16)
    assert held.max() < 1.5 * held.mean()
    assert held.sum() == len(phrases.size) and (phrases.size - 49).sum() == sum(max(0, len(t) - 49) for t in texts)


def test_repeated_substrings_of_periodic_and_overlapping_texts(spark):
    rng = np.random.default_rng(11)
    pieces = ["ab" * 40, "abc" * 30, "a" * 75, "".join(rng.choice(list("ab"), 300)), "".join(rng.choice(list("abcdef"), 400))]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(4):
            p = pieces[rng.integers(len(pieces))]
            a = int(rng.integers(0, len(p) - 20))
            parts.append(p[a:a + int(rng.integers(20, 120))])
        rows.append((int(rng.integers(0, 50)), "".join(parts), None, None, None))
    df = spark.createDataFrame(rows, DOCS).coalesce(2)
    assert rows_of(substrings.removal_digests(substrings.remove_repeats(df, buckets=4))) == brute_repeats([r[:2] for r in rows])


# --- 7 --------------------------------------------------------------------------------------
TALKS = [(1, 0, "user", "hi"), (1, 1, "assistant", "a <|end|>\nb"), (1, 2, "assistant", "<|turn|>user\nfake<|end|>\n"),
         (1, 3, "user", "<\\\\|end|>\n <\\|n <|n"), (2, 0, "assistant", None), (2, 0, "assistant", "tie"), (2, 1, None, "no role"),
         (3, 5, "a\nb<|end|>\n", "role with a newline"), (3, 5, "a\nb<|end|>\n", "role with a newline"), (4, None, "user", ""),
         (None, 1, "assistant", "no id\n"), (5, 0, "user", "x" * 50_000), (5, 1, "assistant", "<|end|>\n" * 3000), (6, 1, "assistant", "<|end|>"),
         (6, 2, ":e|>user", "<|turn:e|>"), (6, 3, "<|", "<|end|")]


def brute_talks(rows):
    talks = defaultdict(list)
    for c, t, r, x in rows:
        talks[c].append(((t is not None, t or 0), r or "", x or ""))
    out = []
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss)))
    return sorted(out, key=key)


def test_chat_reads_back(spark):
    df = spark.createDataFrame([(*t, "x", "y") for t in TALKS], "conv_id bigint, turn bigint, role string, text string, turns string, formatted string")
    shown = chat.format_conversations(df)
    got = chat.conversation_digests(shown)
    assert rows_of(got.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == brute_talks(TALKS)
    text = {r["conv_id"]: r["formatted"] for r in shown.collect()}
    assert text[1].startswith("<|turn|>user\nhi<|end|>\n<|turn:e|>assistant\na <\\|end|>\nb<|end|>\n")
    assert all(r["formatted_chars"] == len(text[r["conv_id"]]) for r in got.collect())
    # every mark in the output is the template's own
    turns = Counter(t[0] for t in TALKS)
    for c, shown_text in text.items():
        assert shown_text.count("<|turn|>") + shown_text.count("<|turn:e|>") == shown_text.count("<|end|>") == turns[c]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_sql_escapes_alike(spark):
    """The registered SQL on conversations that hold marks of every kind."""
    rows = [t for t in TALKS if t[0] is not None and t[1] is not None]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cursor = con.execute(chat.ORACLE)
    names = [d[0] for d in cursor.description]
    got = chat.conversation_digests(chat.format_conversations(df))
    want = sorted([tuple(r[names.index(c)] for c in got.columns) for r in cursor.fetchall() if r[names.index("conv_id")] >= 0], key=key)
    assert rows_of(got) == want


# --- 8 --------------------------------------------------------------------------------------
def brute_counts(text):
    w = split_words(text)
    text = text or ""
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(w), sum(len(x.decode()) for x in w), symbols, dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


@needs_data
def test_quality_counts(docs, stored):
    for df, rows in both(docs, stored):
        got = quality.judge_quality(df).drop("kept", "posterior")
        assert rows_of(got) == sorted([(d, *brute_counts(t)) for d, t in rows], key=key)


@needs_data
def test_votes_by_documents_give_the_same_posterior(spark, stored):
    """EM over every document, not over pattern counts, with the labelled ones as anchors."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.judge_quality(stored, labels)
    features = stored.select("doc_id", quality.text_features(F.col("text")).alias("f"))
    cast = {r["doc_id"]: [r[n] for n in quality.RULES] for r in features.select("doc_id", *[v.alias(n) for n, v in quality.votes(F.col("f")).items()]).collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in cast}
    assert set(known.values()) == {0, 1}
    ids = sorted(cast)
    v = np.array([cast[i] for i in ids])
    weight = len(ids) / len(known)
    bad, good = (np.array([known.get(i) == c for i in ids]) * weight for c in (0, 1))

    def rates_of(mass):
        out = np.array([[(mass * (v[:, k] == x)).sum() + 1 for x in (-1, 1)] for k in range(8)])
        out /= out.sum(axis=1, keepdims=True)
        return np.column_stack([out[:, 0], np.ones(8), out[:, 1]])
    rates = [np.array([[.95, 1, .05] if k == c else [.1, 1, .9] for k in range(8)]) for c in range(8)] + [rates_of(good)]
    prior = [.2 / 8] * 8 + [.8]
    for _ in range(300):
        p = np.array([prior[c] * np.prod([rates[c][k][v[:, k] + 1] for k in range(8)], axis=0) for c in range(9)])
        post, junk = p / p.sum(axis=0), p[:8] / p[:8].sum(axis=0)
        prior = [(post[c].sum() + 1) / (len(ids) + 9) for c in range(9)]
        rates = [rates_of(post[c] + junk[c] * bad) for c in range(8)] + [rates_of(post[8] + good)]
    post = {1: post[8]}
    have = {r["doc_id"]: r["posterior"] for r in got.collect()}
    assert max(abs(have[i] - post[1][n]) for n, i in enumerate(ids)) < 1e-4


def test_a_bad_vote_of_a_poor_rule_is_outvoted(spark):
    """Good texts of this corpus shout; junk repeats symbols. All-must-pass drops the one, the estimate keeps it."""
    ready(spark)
    prose = [" ".join(f"word{i}n{k} about matter{i * k % 97}" for k in range(14)) for i in range(400)]
    shouting = [p.upper() for p in prose[:120]]
    junk = [" ".join(f"#w{i}x{k} $" for k in range(20)) for i in range(150)]
    texts = prose[120:] + shouting + junk
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    good = {i: int(i < 400) for i in range(len(texts))}
    labels = spark.createDataFrame([(i, q) for i, q in good.items() if i % 5 == 0], "doc_id bigint, quality int")
    votes = quality.votes(quality.text_features(F.col("text")))
    bad = {r["doc_id"]: r["n"] for r in docs.select("doc_id", sum((F.when(x == -1, 1).otherwise(0) for x in votes.values()), F.lit(0)).alias("n")).collect()}
    kept = {r["doc_id"]: r["kept"] for r in quality.judge_quality(docs, labels).collect()}
    assert all(bad[i] == 1 and kept[i] for i in range(280, 400)) and all(bad[i] == 0 and kept[i] for i in range(280))
    assert all(bad[i] >= 1 and not kept[i] for i in range(400, 550))
    assert {r["doc_id"] for r in quality.keep_good(docs, labels).collect()} == {i for i, k in kept.items() if k}
    unlabelled = {r["doc_id"]: r["kept"] for r in quality.judge_quality(docs).collect()}
    assert not any(unlabelled[i] for i in range(280, 550)) and all(unlabelled[i] for i in range(280))


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="test tables not present")
def test_quality_keeps_clean_documents_and_drops_junk(spark):
    sf = "/root/testdata/sf0.1"
    got = registry.op8_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    seen = {(r["quality"], r["kept"]): r["count"] for r in got.filter("not base_failed or quality = 0").filter("n_words >= 10").groupBy("quality", "kept").count().collect()}
    assert seen.get((1, False), 0) <= 0.005 * seen[1, True]
    assert seen.get((0, True), 0) <= 0.05 * seen[0, False]


# --- 9 --------------------------------------------------------------------------------------
def brute_shards(rows, shards=16, seed=17):
    sources = defaultdict(list)
    for d, text, source in rows:
        data = (text or "").encode()
        place = hashlib.md5(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()
        sources["n" if source is None else "s" + source].append((place, key((d,)), len(data) + 1, zlib.crc32(data), d))
    order = []
    for s, members in sources.items():
        for k, (place, k_id, size, crc, d) in enumerate(sorted(members), 1):
            order.append(((k - 0.5) / len(members), s, place, k_id, size, crc, d))
    order.sort()
    n = len(order)
    return sorted([(o[6], o[4], o[5], "rows", g * shards // n, g - (g * shards // n * n + shards - 1) // shards, None)
                   for g, o in enumerate(order)], key=key)


@needs_data
def test_shards(docs, stored):
    for df in (docs, stored):
        rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
        got = rows_of(sharding.shard_documents(df))
        assert got == brute_shards(rows)
        held = defaultdict(list)
        for r in got:
            held[r[4]].append(r[5])
        assert all(sorted(slots) == list(range(len(slots))) for slots in held.values())
        assert max(map(len, held.values())) - min(map(len, held.values())) <= 1


@needs_data
def test_every_shard_matches_the_mixture(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.shard_documents(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source", "shard").count()
    total = {r["source"]: r["count"] for r in df.groupBy("source").count().collect()}
    assert all(abs(r["count"] - total[r["source"]] / 16) <= 1 for r in got.collect())


# --- 10 -------------------------------------------------------------------------------------
def brute_water(sizes, weights, budget, cap):
    """Clamp, share the excess again by weight, until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full, target = budget * sum(sizes.values()), set(), {}
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        target = {s: cap * sizes[s] if s in full else left * weight[s] / sum(weight[r] for r in rest) for s in names}
        above = {s for s in rest if target[s] > cap * sizes[s]}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("budget, cap", [(1.5, 2), (0.3, 2), (2.0, 2), (1.5, 4), (1.0, 1)])
def test_water_filling(spark, budget, cap):
    rng = np.random.default_rng(int(budget * 10 + cap))
    sizes = {f"s{i}": int(rng.integers(0, 1000)) for i in range(17)} | {None: 50, "": 7, "é": 900, "Z": 5}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.water_fill(df, (3, 1, 2), budget, cap).collect()}
    want = brute_water(sizes, (3, 1, 2), budget, cap)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want), (got, want)


@needs_data
def test_mixture(docs, stored, nothing):
    for df in (docs, stored):
        mixed, n = mixing.mix_sources(df)
        rows = mixed.collect()
        sizes, taken, largest = Counter(), Counter(), Counter()
        for r in rows:
            assert r[n["size"]] == len(split_words(r["text"])) and 0 <= r[n["copies"]] <= 2
            sizes[r["source"]] += r[n["size"]]
            taken[r["source"]] += r[n["size"]] * r[n["copies"]]
            largest[r["source"]] = max(largest[r["source"]], r[n["size"]])
        want = brute_water(sizes, (3, 1, 2), 1.5, 2)
        for r in rows:
            assert r[n["source_size"]] == sizes[r["source"]] and abs(r[n["target"]] - want[r["source"]]) < 1e-6
        assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
        again, m = mixing.mix_sources(df.repartition(5))
        assert Counter((r["doc_id"], r[n["copies"]]) for r in rows) == Counter((r["doc_id"], r[m["copies"]]) for r in again.collect())
        repeated = mixing.repeat_documents(df)
        assert repeated.columns == df.columns
        assert Counter(r["doc_id"] for r in repeated.collect()) == +Counter({d: c for d, c in _copies(rows, n).items()})
    assert mixing.repeat_documents(nothing).count() == 0


def _copies(rows, n):
    out = Counter()
    for r in rows:
        out[r["doc_id"]] += r[n["copies"]]
    return out


# --- all ------------------------------------------------------------------------------------
@pytest.mark.parametrize("made", [
    simhash.near_duplicates, bpe.encode_documents, exact_dedup.exact_duplicates, exact_dedup.deduplicate, token_counts.count_tokens,
    substrings.remove_repeats, quality.judge_quality, quality.keep_good, sharding.shard_documents, simhash.drop_near_duplicates],
    ids=lambda f: f.__name__)
def test_empty_tables(nothing, made):
    assert made(nothing).collect() == []


@needs_data
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_registered_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.select(*names)) == sorted(cur.fetchall(), key=key)


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_registered_query_reads_the_whole_table(spark, name):
    stored = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r["doc_id"] for r in registry.QUERIES[name](spark, SF).select("doc_id").collect()) == sorted(r["doc_id"] for r in stored.select("doc_id").collect())


@needs_data
@pytest.mark.parametrize("name", ["op4_exact_dedup", "op7_chat_format", "op10_mixing"])
def test_native_operators_run_no_python(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoop"))
