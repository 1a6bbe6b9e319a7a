"""Small inputs that every operator must take."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
# names that the operators use inside
EXTRA = ("size", "copies", "target", "_key", "fp", "root", "bucket", "block", "digest", "rank", "uid", "kept", "pattern",
         "_row_key", "_features", "_turn", "shard", "part")

LONG = "the quick brown fox jumps over the lazy dog near a river bank " * 4000
PASSAGE = "This passage of well over fifty bytes stands in several documents of the fixture, word for word."
CLEAN = [f"Document number {i} tells about subject {i * 7} and then about matter {i * 13} in plain prose of {i * 31} parts, "
         f"which nobody else has, since the count {i * 101} is its own." for i in range(30)]
ODD = ["", None, " \n\t ", "word", "Σίσυφος ΑΣ ß İstanbul ﬁ e\u0301a\u0301", "a\u00a0b\u2003c\u0085d \x1c\x1f e", "\x00nul\x00 bytes",
       "<|endoftext|> in <|startoftext|>text<|endoftext|>", "!!!! ???? #$%& | <|> ****", "don't we'll I'M they've 'S 123456 ½²٣",
       "日本語 テキスト 漢字かな交じり文 emoji 😀😃 👩‍👩‍👧", "same same same same same same same same same same same same",
       "line\nline\nline\n\nline\nother", "x" * 3000, "ab" * 2000, "a" * 49, "b" * 50, "b" * 120]


def documents():
    rows = [(i, t, "en", f"src{i % 4}", None) for i, t in enumerate(CLEAN)]
    rows += [(100 + i, t, None, None if i % 3 else "src0", i) for i, t in enumerate(ODD)]
    rows += [(200, LONG, "en", "long", 1), (201, LONG.upper(), "en", "long", 1), (202, LONG[:-70] + "end of it", "en", "", 1)]
    rows += [(300 + i, CLEAN[3].replace(" ", "  ") if i % 2 else CLEAN[3], "en", "src1", 0) for i in range(12)]   # equal texts
    rows += [(400 + i, f"{i} {CLEAN[i]} {PASSAGE} end {i * 17}", "en", "src2", 0) for i in range(8)]
    rows += [(5, CLEAN[5], "en", "src1", None), (5, CLEAN[5], "en", "src1", None), (6, "another text under a used id", "fr", None, None)]
    rows += [(None, CLEAN[4], None, None, None), (None, "only here, without an id, ten words and a few more to count", None, "src9", None)]
    return rows


def frame(spark, rows=None, extra=True):
    df = spark.createDataFrame(documents() if rows is None else rows, DOCS).repartition(3)
    df = spark.createDataFrame(df.collect(), DOCS).coalesce(3)   # a stored order: rows come back alike every time
    if extra:
        from pyspark.sql import functions as F
        for name in EXTRA:
            df = df.withColumn(name, F.lit(f"mine {name}"))
    return df
