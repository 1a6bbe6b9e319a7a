"""Quality rules as weak supervision.

Every rule votes good, bad or abstains. Votes of all documents are counted by pattern in Spark; the
pattern counts (at most ``3 ** rules``, by label) are all that expectation-maximisation needs to estimate
how good and bad documents vote. A bounded sample of labelled documents anchors the two classes: junk
is of several kinds, each of which breaks one or two rules, and without anchors the largest kind passes
for a kind of good document. A document's posterior probability of being good then replaces the demand
that it pass every rule: bad votes of a rule that also fails good documents are outvoted.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable_checkpoint, free_names

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
SYMBOLS = "#*$%&|<>"
WORDLIKE = re.compile(rb"[0-9A-Za-z\x80-\xff]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_marks",
          "n_wordless", "n_distinct")
FEATURES = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text; all 0 for null or empty.

    ``n_wordless``: words without a letter or digit; ``n_marks``: exclamation and question marks.
    """
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode()
    words = data.split()   # splits at [\x20\x09-\x0D], as all bytes methods do
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    blank = sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    bare = data.translate(None, UPPER)
    distinct = set(words)
    odd = {w for w in distinct if not WORDLIKE.search(w)}
    wordless = sum(w in odd for w in words) if odd else 0
    return (n, len(text) - blank, sum(map(text.count, SYMBOLS)), dup, repeated_words(words), lines, len(data) - len(bare),
            len(bare) - len(bare.translate(None, LOWER)), data.count(b"!") + data.count(b"?"), wordless, len(distinct))


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that the text holds twice or more."""
    grams = list(zip(*(words[k:] for k in range(width)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen: set[tuple[bytes, ...]] = set()
    again = {g for g in grams if g in seen or seen.add(g)}
    covered = reached = 0
    for i, g in enumerate(grams):
        if g in again:
            covered += i + width - max(i, reached)
            reached = i + width
    return covered


def text_features(text: Column) -> Column:
    @F.arrow_udf(FEATURES)
    def counted(texts: pa.Array) -> pa.Array:
        rows = np.array([text_counts(t.as_py()) for t in texts], np.int64).reshape(-1, len(COUNTS))
        return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(COUNTS))], list(COUNTS))
    return counted(text.cast("string"))


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])


def votes(f: Column) -> dict[str, Column]:
    """1 good, -1 bad, 0 abstains. Bounds leave a gap in which a rule does not judge."""
    n, lines = F.greatest(f["n_words"], F.lit(1)), F.greatest(f["n_lines"], F.lit(1))
    letters = F.greatest(f["n_upper"] + f["n_lower"], F.lit(1))

    def rule(value: Column, good: float, bad: float, judges: Column | None = None) -> Column:
        vote = F.when(value <= good, 1).when(value > bad, -1).otherwise(0)
        return vote if judges is None else F.when(judges, vote).otherwise(0)
    mean = f["word_chars"] / n
    return {
        "symbols": rule(f["n_symbols"] / n, 0.05, 0.2),
        "capitals": rule(f["n_upper"] / letters, 0.25, 0.6, f["n_words"] >= 5),
        "marks": rule(f["n_marks"] / n, 0.1, 0.4, f["n_words"] >= 5),
        "wordless": rule(f["n_wordless"] / n, 0.12, 0.2),
        "repeats": rule(f["n_repeat_words"] / n, 0.1, 0.2),
        "lines": rule(f["n_dup_lines"] / lines, 0.15, 0.5, f["n_lines"] >= 4),
        "word_length": F.when(mean.between(2.5, 12.0), 1).when((mean < 2.0) | (mean > 20.0), -1).otherwise(0),
        "length": rule(-f["n_words"], -20, -10),
    }


RULES = ("symbols", "capitals", "marks", "wordless", "repeats", "lines", "word_length", "length")
PATTERNS = 3 ** len(RULES)
FALSE_ALARM = 0.002    # without labels: the largest share of good documents that one rule may vote against
ANCHORS = 20_000       # labelled documents, at most, that anchor the classes


def pattern_of(f: Column) -> Column:
    """The votes as one number in base 3."""
    cast, number = votes(f), F.lit(0)
    for name in RULES:
        number = number * 3 + cast[name] + 1
    return number.cast("int")


def pattern_votes() -> np.ndarray:
    """``(patterns, rules)`` with 0 bad, 1 abstains, 2 good."""
    p = np.arange(PATTERNS)
    return np.stack([p // 3 ** (len(RULES) - 1 - k) % 3 for k in range(len(RULES))], axis=1)


def fit_votes(counts: np.ndarray, anchors: np.ndarray | None = None, steps: int = 200, tolerance: float = 1e-10) -> np.ndarray:
    """Posterior probability of good for every vote pattern, by expectation-maximisation.

    ``counts``: documents per pattern, over the whole corpus. The classes are good and one kind of junk for each
    rule, which begins as the junk that this rule finds; all rates are then estimated, from votes that were cast. ``anchors``: ``(2, patterns)``,
    how the labelled bad and good documents voted: good ones are of the good class, bad ones of any of the
    others. Together they weigh as much in the rates as all other documents; the classes' shares come from the
    corpus alone. One pseudo-document a cell keeps rates inside (0, 1). Without documents of both labels, a
    rule's bad votes may fall on at most ``FALSE_ALARM`` of the good ones, an assumption in the place of evidence.
    """
    cast, total, kinds = pattern_votes(), counts.sum(), len(RULES)
    rates = np.tile([0.1, 1.0, 0.9], (kinds + 1, kinds, 1))   # an abstention tells nothing
    rates[np.arange(kinds), np.arange(kinds)] = [0.95, 1.0, 0.05]
    rates[kinds] = [0.02, 1.0, 0.98]
    prior = np.r_[np.full(kinds, 0.2 / kinds), 0.8]
    anchored = anchors is not None and bool((anchors.sum(axis=1) > 0).all())
    bad, good = anchors * (total / anchors.sum()) if anchored else np.zeros((2, len(counts)))
    if anchored:
        rates[kinds] = vote_rates(good[None], cast)[0]
    before = -np.inf
    for _ in range(steps):
        logs = np.log(prior)[:, None] + np.log(rates)[:, np.arange(kinds), cast].sum(axis=2)
        top = logs.max(axis=0)
        shares = np.exp(logs - top)
        evidence = shares.sum(axis=0)
        posterior = shares / evidence
        likelihood = float((counts * (top + np.log(evidence))).sum())
        if not total or abs(likelihood - before) <= tolerance * max(1.0, abs(likelihood)):
            break
        before = likelihood
        mass = posterior * counts
        prior = (mass.sum(axis=1) + 1) / (total + kinds + 1)
        junk = np.exp(logs[:kinds] - logs[:kinds].max(axis=0))
        mass[:kinds] += junk / junk.sum(axis=0) * bad
        mass[kinds] += good
        rates = vote_rates(mass, cast)
        if not anchored:
            hold_alarms(rates)
    return posterior[kinds]


def vote_rates(mass: np.ndarray, cast: np.ndarray) -> np.ndarray:
    """``(classes, rules, 3)``: how each class votes where it votes, from its mass per pattern; 1 for abstentions."""
    bad, good = (mass @ (cast == vote) + 1 for vote in (0, 2))
    return np.stack([bad / (bad + good), np.ones_like(bad), good / (bad + good)], axis=2)


def hold_alarms(rates: np.ndarray) -> None:
    """Limit the good class's bad-vote rates."""
    rates[-1, :, 0] = np.minimum(rates[-1, :, 0], FALSE_ALARM)
    rates[-1, :, 2] = 1 - rates[-1, :, 0]


def labelled_sample(labels: DataFrame, size: int = ANCHORS) -> DataFrame:
    """``_labelled, _good`` of at most ``size`` documents, drawn by a hash of their id; one bad label makes a document bad."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("_labelled")).agg(F.min("quality").alias("_good"))
    return F.broadcast(known.orderBy(F.xxhash64("_labelled"), "_labelled").limit(size))


def fit_patterns(patterns: DataFrame, labels: DataFrame | None) -> np.ndarray:
    """The posterior by pattern, from rows of ``_id, pattern``; at most ``3 * PATTERNS`` counts reach the driver."""
    good = F.lit(None).cast("int").alias("_good")
    if labels is not None:
        patterns, good = patterns.join(labelled_sample(labels), F.col("_id") == F.col("_labelled"), "left"), F.col("_good").cast("int").alias("_good")
    counts, anchors = np.zeros(PATTERNS), np.zeros((2, PATTERNS))
    for row in patterns.groupBy("pattern", good).count().toLocalIterator():
        counts[row["pattern"]] += row["count"]
        if row["_good"] is not None:
            anchors[row["_good"], row["pattern"]] += row["count"]
    return fit_votes(counts, anchors)


def judge_quality(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                  least: float = 0.5) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and ``posterior`` for every row.

    ``labels`` (doc_id, quality 0 or 1): of them at most ``ANCHORS`` documents anchor the estimate; other values
    and null ids are left out. Null and empty texts have no words and fail the base rules. Repeated rows are
    judged alike. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_features(F.col(f"`{text_col}`")).alias("f"))
    rows = durable_checkpoint(rows.withColumn("pattern", pattern_of(F.col("f"))))
    lookup = posterior_table(rows, fit_patterns(rows.select(F.col("doc_id").alias("_id"), "pattern"), labels))
    return rows.join(lookup, "pattern").select(
        "doc_id", *[F.col(f"f.{c}").alias(c) for c in COUNTS[:5]], base_failed(F.col("f")).alias("base_failed"),
        (~base_failed(F.col("f")) & (F.col("posterior") >= least)).alias("kept"), "posterior")


def posterior_table(df: DataFrame, posterior: np.ndarray) -> DataFrame:
    """``pattern, posterior`` for all patterns: 6,561 rows, a size fixed by the number of rules."""
    return F.broadcast(df.sparkSession.createDataFrame(list(enumerate(posterior.tolist())), "pattern int, posterior double"))


def keep_good(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
              least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; labels and odd rows as in ``judge_quality``.

    Texts are counted once for the vote statistics and once for the decision, which needs no shuffle.
    """
    f = text_features(F.col(f"`{text_col}`"))
    posterior = fit_patterns(docs.select(F.col(f"`{id_col}`").alias("_id"), pattern_of(f).alias("pattern")), labels)
    # the verdict of every pattern as one letter of a string, so that one filter sees the text's counts once
    verdicts = F.lit("".join("y" if p >= least else "n" for p in posterior))
    return docs.filter(~base_failed(f) & (F.substring(verdicts, pattern_of(f) + 1, F.lit(1)) == "y"))
