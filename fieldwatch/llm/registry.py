"""One registered query per operator, over whole tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, byte_bpe, chat, exact_dedup, filter_audit, mixing, quality, sharding, simhash, substrings, token_counts, url_filter,
               vector_codes)
from .common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(bpe.encode_documents(table(spark, sf_dir, "documents")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digests(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat.PROBE).alias("text"))
    return chat.conversation_digests(chat.format_conversations(talks.unionByName(probe)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, n = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col(n["size"]).alias("size"), F.col(n["source_size"]).alias("source_size"),
                        F.col(n["target"]).alias("target"), (F.col(n["size"]) * F.col(n["copies"])).alias("taken"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_table(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded_digests(byte_bpe.encode_documents(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_url_filter, op3_bpe, op4_exact_dedup, op5_token_counts, op6_suffix_array_dedup,
    op7_chat_format, op8_quality_rules, op9_sharding, op10_mixing, op11_vector_codes, op12_filter_audit, op13_byte_bpe)}

SQL: dict[str, str] = {"op2_url_filter": url_filter.ORACLE, "op4_exact_dedup": exact_dedup.ORACLE,
                       "op7_chat_format": chat.ORACLE, "op10_mixing": mixing.ORACLE,
                       "op11_vector_codes": vector_codes.ORACLE, "op12_filter_audit": filter_audit.ORACLE}
