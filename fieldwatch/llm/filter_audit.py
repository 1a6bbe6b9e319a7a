"""How five document filters interact, under every order of applying them.

One pass of a table-driven transducer over a text's UTF-8 bytes counts words, capitals, code points and
symbols, and hands every word span to a hash table that verifies its bytes. Which filters a document
fails fits five bits; documents are counted by these bits, and the audit of all orders is arithmetic on
at most 32 counts for each part of the corpus.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable_checkpoint

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SPACE, CAPITAL, SYMBOL, INNER, OTHER = range(5)     # classes of bytes; INNER: not the first byte of a code point
OUTSIDE, INSIDE = range(2)                          # states: between words, in a word
BEGINS, ENDS, IS_CAPITAL, IS_POINT, IS_SYMBOL = (1 << k for k in range(5))   # what a step emits
BLOCK = 1 << 20                                     # bytes of a text taken at once
COUNTS = "struct<words:bigint,distinct_words:bigint,capitals:bigint,points:bigint,symbols:bigint>"


def byte_classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = SPACE
    out[ord("A"):ord("Z") + 1] = CAPITAL
    out[list(b"#$%&*|")] = SYMBOL
    out[0x80:0xC0] = INNER
    return out


def step_tables() -> tuple[np.ndarray, np.ndarray]:
    """The next state, and what is emitted, by state and class of the byte read."""
    after = np.full((2, 5), INSIDE, np.uint8)
    after[:, SPACE] = OUTSIDE
    emitted = np.zeros((2, 5), np.uint8)
    emitted[:, [SPACE, CAPITAL, SYMBOL, OTHER]] |= IS_POINT
    emitted[:, CAPITAL] |= IS_CAPITAL
    emitted[:, SYMBOL] |= IS_SYMBOL
    emitted[OUTSIDE, [CAPITAL, SYMBOL, INNER, OTHER]] |= BEGINS
    emitted[INSIDE, SPACE] |= ENDS
    return after, emitted


CLASSES = byte_classes()
AFTER, EMITTED = step_tables()


def text_counts(data: bytes, block: int = BLOCK) -> tuple[int, int, int, int, int]:
    """Words, distinct words, capitals, code points and symbols of one whole text, in one pass.

    Every state is entered by the class of the last byte alone, so the states of a whole block come from
    one look-up. State and a word cut by the block's end are carried into the next block.
    """
    words = capitals = points = symbols = 0
    table: set[bytes] = set()     # hashes a word's bytes and compares them with what it finds
    state, carried = OUTSIDE, b""
    for at in range(0, len(data), block):
        piece = data[at:at + block]
        classes = CLASSES[np.frombuffer(piece, np.uint8)]
        states = np.empty(len(classes) + 1, np.uint8)
        states[0] = state
        states[1:] = AFTER[OUTSIDE, classes]
        emitted = EMITTED[states[:-1], classes]
        capitals += int(np.count_nonzero(emitted & IS_CAPITAL))
        points += int(np.count_nonzero(emitted & IS_POINT))
        symbols += int(np.count_nonzero(emitted & IS_SYMBOL))
        begins, ends = np.flatnonzero(emitted & BEGINS).tolist(), np.flatnonzero(emitted & ENDS).tolist()
        words += len(begins)
        if state == INSIDE:
            if not ends:                      # the whole block lies in one word
                carried += piece
                continue
            table.add(carried + piece[:ends.pop(0)])
        state = int(states[-1])
        carried = piece[begins.pop():] if state == INSIDE else b""
        table.update([piece[a:b] for a, b in zip(begins, ends, strict=True)])
    if state == INSIDE:
        table.add(carried)
    return words, len(table), capitals, points, symbols


def count_column(text: Column) -> Column:
    @F.arrow_udf(COUNTS)
    def counted(texts: pa.Array) -> pa.Array:
        rows = np.array([text_counts(t.as_py()) for t in texts], np.int64).reshape(-1, 5)
        return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(5)],
                                          ["words", "distinct_words", "capitals", "points", "symbols"])
    return counted(text.cast("binary"))


def failures(c: Column) -> Column:
    """The bits of filters A to D, lowest first."""
    return sum((F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate((
        c["words"] < 200, 100 * c["distinct_words"] < 50 * c["words"], 100 * c["capitals"] > 3 * c["points"], c["symbols"] > 0))),
        F.lit(0))


def judged_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``id, digest, part, mask, good, toxic`` for every document; the only step that reads texts."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), count_column(text).alias("c"))
    rows = rows.select("id", "part", "digest", failures(F.col("c")).alias("mask"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = durable_checkpoint(rows)
    no = F.lit(False)
    return (rows.filter("id is not null").join(marks, "id", "left")
            .select("id", "part", "digest", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
            .unionByName(rows.filter("id is null").select("*", no.alias("good"), no.alias("toxic"))))


def counts_by_failure(rows: DataFrame) -> DataFrame:
    """``part, mask, good, toxic, n`` with the bit of filter E: an equal text has a smaller id.

    Rows of equal texts are counted by id, then by part and labels, before any of them meet, so a
    text that a third of all rows share reaches the last step as few rows.
    """
    same = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy(*same, "id").agg(F.count(F.lit(1)).alias("n"))
    groups = durable_checkpoint(by_id.groupBy(*same).agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least")))
    first = groups.groupBy("digest").agg(F.min("least").alias("first"))
    known = groups.join(first, "digest")
    # rows that have the text's smallest id pass; where no row of the text has an id, all of them do
    passing = F.when(F.col("first").isNull(), F.col("n")).when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    split = known.select("part", "good", "toxic", F.explode(F.array(
        F.struct("mask", passing.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passing).alias("n")))).alias("s"))
    return split.filter("s.n > 0").groupBy("part", F.col("s.mask").alias("mask"), "good", "toxic").agg(F.sum("s.n").alias("n"))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, filter order and step; see the module for the columns' meaning.

    Null texts count as empty, a null part as the empty string. A document is good (toxic) where any
    ``labels`` row of its id has quality (toxic) 1; null ids have no labels. Rows of equal text: those
    with the smallest id pass filter E, all others fail it, null ids behind all others; repeated rows
    that share the smallest id pass together. An empty table gives no rows. Other columns are not read.
    """
    counts = counts_by_failure(judged_rows(docs, labels, id_col, text_col, part_col))

    def by_mask(of: Column) -> Column:
        return F.array(*[F.sum(F.when(F.col("mask") == m, of).otherwise(0)) for m in range(32)])
    parts = counts.groupBy("part").agg(
        by_mask(F.col("n")).alias("all"), by_mask(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        by_mask(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    # 600 steps: which order, which step, the filters before it and its own filter
    steps = parts.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) * 5 - 1))).alias("at"))
    before = [sum(1 << FILTERS.index(f) for f in order[:k]) for order in ORDERS for k in range(5)]
    own = [1 << FILTERS.index(order[k]) for order in ORDERS for k in range(5)]
    steps = steps.select(
        "part", "all", "good", "toxic", F.element_at(F.lit(ORDERS), F.floor(F.col("at") / 5).cast("int") + 1).alias("filter_order"),
        (F.col("at") % 5 + 1).cast("int").alias("step"), F.element_at(F.lit(before), F.col("at") + 1).alias("before"),
        F.element_at(F.lit(own), F.col("at") + 1).alias("own"))

    def total(name: str, of) -> Column:
        """The counts of all masks that ``of`` takes."""
        return F.aggregate(F.transform(F.col(name), lambda n, m: n * of(m).cast("bigint")), F.lit(0).cast("bigint"), lambda a, n: a + n)

    def fails(m: Column, which: str) -> Column:
        return m.bitwiseAND(F.col(which)) != 0

    def removed(m: Column) -> Column:
        return fails(m, "own") & ~fails(m, "before")
    return steps.select(
        "part", "filter_order", "step", total("all", lambda m: ~fails(m, "own") & ~fails(m, "before")).alias("kept"),
        total("all", removed).alias("removed"), total("all", lambda m: fails(m, "own") & fails(m, "before")).alias("redundant"),
        total("all", lambda m: m == F.col("own")).alias("unique_fails"), total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        # of a document that fails k filters, each of them is the first in 120 / k orders
        total("all", lambda m: F.when(fails(m, "own"), F.lit(len(ORDERS)) / F.greatest(F.bit_count(m), F.lit(1))).otherwise(0)).alias("shapley"))


def oracle() -> str:
    letters = ", ".join(f"('{f}', {1 << k})" for k, f in enumerate(FILTERS))
    word = r"'[^\x20\x09-\x0D]+'"
    return f"""
with texts as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents
), counted as (
    select doc_id, part, t, regexp_extract_all(t, {word}) as w,
           length(regexp_replace(t, '[^A-Z]', '', 'g')) as capitals, length(t) as points from texts
), firsts as (
    select t, min(doc_id) as first from texts group by t
), marks as (
    select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic
    from labels where doc_id is not null group by doc_id
), judged as (
    select c.part, coalesce(m.good, false) as good, coalesce(m.toxic, false) as toxic,
           case when len(w) < 200 then 1 else 0 end
           + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
           + case when 100 * capitals > 3 * points then 4 else 0 end
           + case when regexp_matches(c.t, '[#$%&*|]') then 8 else 0 end
           + case when f.first is not null and (c.doc_id is null or c.doc_id > f.first) then 16 else 0 end as mask
    from counted c join firsts f on c.t = f.t left join marks m on m.doc_id = c.doc_id
), counts as (
    select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
    from judged group by part, mask
), letters(f, bit) as (
    values {letters}
), orders as (
    select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
    from letters a, letters b, letters c, letters d, letters e
    where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), steps as (
    select filter_order, s.step, bits[s.step] as own, coalesce(list_sum(bits[1:s.step - 1]), 0)::int as before
    from orders, (select unnest([1, 2, 3, 4, 5]) as step) s
), audit as (
    select part, filter_order, step, own,
           sum(case when mask & (own | before) = 0 then n else 0 end) as kept,
           sum(case when mask & own > 0 and mask & before = 0 then n else 0 end) as removed,
           sum(case when mask & own > 0 and mask & before > 0 then n else 0 end) as redundant,
           sum(case when mask = own then n else 0 end) as unique_fails,
           sum(case when mask & own > 0 and mask & before = 0 then good else 0 end) as good_lost,
           sum(case when mask & own > 0 and mask & before = 0 then toxic else 0 end) as toxic_lost
    from counts, steps group by part, filter_order, step, own
)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
       unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       (sum(removed) over (partition by part, own))::bigint as shapley
from audit"""


ORACLE = oracle()
