"""One query per operator: thin wrappers that apply it to its whole table and return its digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from silvagrid.llm import (
    collocations, conversations, embed_dedup, fingerprints, leaks, near_dedup, quality_kn, raking, repeats, shards, token_counts, url_rules,
    wavelet,
)
from silvagrid.llm.sql import ORACLES
from silvagrid.session import small_frame

Query = Callable[[SparkSession, str], DataFrame]

#: The rules of the URL query (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, folder, "embeddings"))


def op3_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.shard_report(table(spark, folder, "documents"))


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = small_frame(spark, URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, folder, "pages"), rules)


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leak_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), shingle=4)


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_kn.judge_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return wavelet.token_report(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = raking.mix(table(spark, folder, "documents"))
    return mixed.withColumn("probability", F.round("probability", 6))


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.repeat_report(table(spark, folder, "documents"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, folder, "documents"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair_report(conversations.damaged(table(spark, folder, "conversations")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_token_counts, op2_embedding_dedup, op3_shards, op4_url_filter, op5_decontamination, op6_near_dedup, op7_quality, op8_token_files, op9_mixing, op10_suffix_dedup, op11_collocations,
    op12_fingerprints, op13_conversation_repair)}

__all__ = ["ORACLES", "QUERIES"]
