"""The pipeline over documents: quality rules, near copies, benchmark passages, mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from semproxy.llm import decontaminate, mixing, ngram_join, quality, sharding
from semproxy.llm.common import documents, written
from semproxy.llm.oracles import PIPELINE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality rules reject go."""
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of similar documents the one with the smallest id stays."""
    return ngram_join.keep_one_per_class(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a benchmark item go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned out to their target weights."""
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard of near equal bytes and its slot there."""
    return sharding.shard_rows(docs, 8)


STAGES = [
    ("quality rules", quality_rules),
    ("near copies", near_copies),
    ("benchmark passages", benchmark_passages),
    ("mix to weights", mix_to_weights),
    ("shards", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each reading what the one before it wrote."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs


ORACLE_SQL = PIPELINE

PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_ORACLES = {"pipeline": ORACLE_SQL}
