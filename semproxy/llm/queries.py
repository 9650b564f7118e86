"""One query per operator over the whole tables; ORACLES has DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from semproxy.llm import (
    decontaminate,
    fingerprints,
    licenses,
    line_chunks,
    mixing,
    ngram_join,
    prefix_trie,
    quality,
    repair,
    secrets,
    sharding,
    suffix_dedup,
    token_counts,
)
from semproxy.llm.common import documents

# A public vocabulary of byte pairs, read on the driver.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


@query
def op1_histogram_shards(spark, sf_dir):
    return sharding.shard_report(documents(spark, sf_dir))


@query
def op3_mix_sources(spark, sf_dir):
    return mixing.mix_report(documents(spark, sf_dir))


@query
def op9_quality_rules(spark, sf_dir):
    return quality.quality_report(documents(spark, sf_dir), labels(spark, sf_dir))


@query
def op4_secret_scan(spark, sf_dir):
    return secrets.secret_report(documents(spark, sf_dir))


@query
def op5_license_scan(spark, sf_dir):
    return licenses.license_report(documents(spark, sf_dir))


@query
def op2_line_chunks(spark, sf_dir):
    return line_chunks.line_report(documents(spark, sf_dir))


@query
def op10_edited_token_counts(spark, sf_dir):
    return token_counts.count_report(documents(spark, sf_dir), VOCABULARY)


@query
def op7_ngram_join(spark, sf_dir):
    return ngram_join.join_report(documents(spark, sf_dir))


@query
def op8_benchmark_phrases(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination_report(documents(spark, sf_dir), benchmark)


@query
def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeat_report(documents(spark, sf_dir))


@query
def op11_document_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_report(documents(spark, sf_dir))


@query
def op12_conversation_trie(spark, sf_dir):
    return prefix_trie.trie_report(conversations(spark, sf_dir))


@query
def op13_conversation_repair(spark, sf_dir):
    return repair.repair_report(conversations(spark, sf_dir))
