"""The corpus pipeline against brute force, stage by stage and as a whole."""

import hashlib
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fieldwatch.llm import jaccard, quality, simhash
from fieldwatch.llm.common import ready

from .cases import documents, frame
from .test_operators import SF, brute_exact, brute_fingerprint, brute_water, key, needs_data, rows_of, sha, split_words

STAGES = dict(corpus_pipeline.STAGES)


def plain(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def brute_exact_stage(rows):
    out = []
    for group in brute_exact([(r[0], r[1]) for r in rows]).values():
        out.append(rows[min(group)[3]])
    return out


def shingle_set(text):
    """Five-word shingles, A-Z lower-cased; a shorter text is one shingle."""
    w = [x.lower() for x in split_words(text)]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute_groups(texts):
    """The smallest place reachable from each over pairs with a Jaccard similarity of 4/5 or more."""
    sets, top = [shingle_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i
    for b, y in enumerate(sets):
        for a, x in enumerate(sets[:b]):
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((root(a), root(b)))
                top[high] = low
    return [root(i) for i in range(len(texts))]


def brute_print_groups(texts, distance=4):
    """The smallest place reachable from each over fingerprints of ``distance`` or fewer differing bits."""
    prints, top = [brute_fingerprint(t) for t in texts], list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i
    for b, y in enumerate(prints):
        for a, x in enumerate(prints[:b]):
            if (x ^ y).bit_count() <= distance:
                low, high = sorted((root(a), root(b)))
                top[high] = low
    return [root(i) for i in range(len(texts))]


def brute_near_stage(rows):
    group, first = brute_print_groups([r[1] for r in rows]), {}
    for r, g in zip(rows, group):
        if r[0] is not None:
            first[g] = min(first.get(g, r[0]), r[0])
    gone = {r[0] for r, g in zip(rows, group) if r[0] is not None and r[0] != first[g]}
    return [r for r in rows if r[0] not in gone]


def brute_mix_stage(rows, seed=29):
    sizes, members = Counter(), defaultdict(list)
    for r in rows:
        n = len(split_words(r[1]))
        sizes[r[3]] += n
        place = hashlib.md5(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()
        members[r[3]].append((place, key((r[0],)), n, key(r), r))
    target, out = brute_water(sizes, (3, 1, 2), 1.5, 2), []
    for s, group in members.items():
        before, whole = 0, int(target[s] // sizes[s]) if sizes[s] else 0
        for _, _, n, _, r in sorted(group, key=lambda g: g[:4]):
            out += [r] * (whole + (2 * before + n < 2 * (target[s] - whole * sizes[s])))
            before += n
    return out


def brute_encode_stage(rows):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        out.append((r[0], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=key)


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mixing", "bpe"]


NEAR = " ".join(f"near{i}" for i in range(60))
#: similar texts whose fingerprints differ widely, equal texts under null and repeated ids
BETWEEN = [(800, NEAR, "en", "src1", 0), (801, NEAR.replace("near59", "other"), "en", "src1", 0), (802, NEAR.replace("near0 ", "else "), None, None, 0),
           (None, NEAR, None, None, None), (803, NEAR.upper(), "en", "src1", 0), (803, NEAR.replace("near30", "far"), "en", "src1", 0),
           (804, NEAR.replace("near30", "far"), "en", "src1", 0), (805, " ".join(NEAR.split()[:40]), "en", "src1", 0)]


def test_stages_on_odd_rows(spark):
    ready(spark)
    docs = frame(spark, documents() + BETWEEN).cache()
    rows = plain(docs)
    kept = STAGES["quality_rules"](spark, docs, "")
    verdict = Counter((r["doc_id"], r["kept"]) for r in quality.judge_quality(docs).collect())
    assert kept.columns == docs.columns
    assert Counter(r[0] for r in plain(kept)) == Counter({d: n for (d, k), n in verdict.items() if k})
    exact = STAGES["exact_dedup"](spark, docs, "")
    assert exact.columns == docs.columns
    # equal rows differ in nothing, so which of them stays cannot be told
    assert sorted([r[:2] for r in plain(exact)], key=key) == sorted([r[:2] for r in brute_exact_stage(rows)], key=key)
    near = STAGES["simhash_near_dedup"](spark, docs, "")
    assert near.columns == docs.columns and sorted(plain(near), key=key) == sorted(brute_near_stage(rows), key=key)
    mixed = STAGES["mixing"](spark, docs, "")
    assert mixed.columns == docs.columns
    assert Counter((r[0], r[1]) for r in plain(mixed)) == Counter((r[0], r[1]) for r in brute_mix_stage(rows))
    assert rows_of(STAGES["bpe"](spark, docs, "")) == brute_encode_stage(rows)


@needs_data
def test_near_stage_is_the_fingerprint_join(spark):
    """Brute force over the fingerprints of sf0.01: the stage drops what op1's components name, and nothing else."""
    ready(spark)
    stored = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in stored.collect())
    group = brute_print_groups([t for _, t in rows])
    got = {r["doc_id"] for r in STAGES["simhash_near_dedup"](spark, stored, "").collect()}
    assert got == {rows[i][0] for i, g in enumerate(group) if g == i}
    assert got == {r["doc_id"] for r in simhash.near_duplicates(stored).filter("doc_id = component_id").collect()}


@needs_data
def test_similar_rows_links_every_similar_pair(spark):
    """Brute force over five-word shingles of sf0.01; four bits of SimHash miss most of these pairs."""
    ready(spark)
    stored = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in stored.collect())

    group = brute_groups([t for _, t in rows])
    prints = [brute_fingerprint(t) for _, t in rows]
    assert any(g != i and (prints[g] ^ prints[i]).bit_count() > 4 for i, g in enumerate(group))
    got = {r["doc_id"] for r in jaccard.drop_similar(stored).collect()}
    assert got == {rows[i][0] for i, g in enumerate(group) if g == i}


def test_dense_groups_of_similar_texts_lose_no_link(spark):
    """Copies of one text that are not all alike pairwise, beside texts that share a passage only."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        w = list(base)
        for k in rng.choice(60, 1, replace=False):
            w[k] = f"x{rng.integers(8)}"
        texts.append(" ".join(w))
    texts += [" ".join([*base[:12], *(f"y{i}_{j}" for j in range(20))]) for i in range(80)]
    rows = [(i, t, None, None, None) for i, t in enumerate(dict.fromkeys(texts))]
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for _, t, *_ in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    got = {r["doc_id"] for r in jaccard.drop_similar(frame(ready(spark), rows, False)).collect()}
    assert got == set(group)


def test_bitmaps_never_hide_a_similar_pair():
    """The bound is at least what two sets share, whatever their sizes, and tells unlike sets apart."""
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 63, 64, 65, 200, 1000, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        for m, common in ((n, n), (n, n * 9 // 10), (n + n // 5, n), (n * 4 // 5, n * 4 // 5), (n, 0), (2 * n, n // 2)):
            b = np.unique(np.concatenate([a[:common], rng.integers(0, 1 << 63, m - common, np.uint64)]))
            bound = jaccard.sharing_bound(jaccard.bitmap(a), len(a), jaccard.bitmap(b), len(b))
            assert len(np.intersect1d(a, b)) <= bound <= min(len(a), len(b))
            if n >= 200 and not common:
                assert 9 * bound < 4 * (len(a) + len(b))


def test_stages_take_empty_tables(spark):
    nothing = frame(spark, [])
    assert all(stage(spark, nothing, "").collect() == [] for stage in STAGES.values())


@needs_data
def test_whole_pipeline(spark, tmp_path):
    ready(spark)
    stored = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in quality.judge_quality(stored, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()}
    rows = [r for r in plain(stored) if r[0] in kept]
    want = brute_encode_stage(brute_mix_stage(brute_near_stage(brute_exact_stage(rows))))
    assert rows_of(corpus_pipeline.run(spark, SF)) == want


def test_the_rest_works_without_this_subpackage(tmp_path):
    """The entry imports and lists the other queries where the folders are absent, and hides no other error."""
    root = Path(corpus_pipeline.__file__).parent
    for name in ("__spark_entry__.py", "fieldwatch"):
        (tmp_path / name).symlink_to(root / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    for item in (root / "fieldwatch").iterdir():
        if item.name not in ("llm", "__pycache__"):
            (tmp_path / "fieldwatch" / item.name).symlink_to(item)
    code = f"import sys; sys.path[:] = [{str(tmp_path)!r}] + [p for p in sys.path if p not in ('', {str(root)!r})]; import importlib.util as u; " \
           f"s = u.spec_from_file_location('entry', {str(tmp_path / '__spark_entry__.py')!r}); m = u.module_from_spec(s); s.loader.exec_module(m); " \
           "q = m.queries(); assert len(q) > 150 and not any(n.startswith('op') or n == 'pipeline' for n in q), list(q)[-3:]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, timeout=120)
