"""Corpus pipeline: documents to the encoded training mixture.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns
a DataFrame; ``run`` writes each result to the shared folder as Parquet and rereads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fieldwatch.llm import bpe, exact_dedup, mixing, quality, simhash
from fieldwatch.llm.common import ready, table
from fieldwatch.session import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; without a folder of tables no labels anchor the rules."""
    ready(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels") if sf_dir else None)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal without white space, the longest stays, then the one of the smallest id."""
    ready(spark)
    return exact_dedup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by fingerprints of 4 or fewer differing bits, the one of the smallest id stays."""
    ready(spark)
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it, which may be never."""
    ready(spark)
    return mixing.repeat_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document of the mixture: its id, ids and decoded text, as digests."""
    ready(spark)
    return bpe.encoded_digests(bpe.encode_documents(docs))


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup_stage), ("simhash_near_dedup", near_dedup),
          ("mixing", mix), ("bpe", encode)]

#: Expectation-maximisation, similarity components and BPE are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
