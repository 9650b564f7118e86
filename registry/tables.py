"""The driver's tables as candidate pools, with the labels and models the queries use."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semproxy.functions.scoring import ProxyModel
from semproxy.operators.cascade import score_rows

SEED = 42

VECTOR_MODEL = ProxyModel(tuple(float(i * 7 % 13 - 6) for i in range(64)), 0.5)
ORDER_MODEL = ProxyModel((2.0, -3.0, 1.5, 4.0, -2.5, 1.0, -1.0, 0.5), -0.75)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with the learnable label and a shard."""
    e = F.col("embedding")
    side = e[0].cast("double") + e[1].cast("double") - e[2].cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        (F.col("vec_id") % 4).cast("int").alias("shard"),
        "embedding",
        F.when(side > 0, 1).otherwise(0).alias("label"),
        (F.col("label") < 5).cast("int").alias("hard"),
        "vec_id",
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the text of the document of the same number, where there is one."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return vectors(spark, sf_dir).join(documents, "vec_id", "left")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as eight-wide vectors: a pool that grows with the scale factor."""
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    parts = [
        F.col("o_totalprice") / 500000,
        (F.col("o_custkey") % 97) / 97,
        (key % 89) / 89,
        F.month(date) / 12,
        F.dayofmonth(date) / 31,
        (F.year(date) - 1990) / 12,
        F.length("o_orderpriority") / 16,
        (key % 7) / 7,
    ]
    return table(spark, sf_dir, "orders").select(
        key.cast("string").alias("id"),
        (key % 3).cast("int").alias("shard"),
        F.array(*[part.cast("float") for part in parts]).alias("embedding"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
    )


def vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_rows(vectors(spark, sf_dir), VECTOR_MODEL)


def order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_rows(orders(spark, sf_dir), ORDER_MODEL)


def order_tied_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores rounded to one digit, so that a few values hold most rows."""
    return order_scores(spark, sf_dir).withColumn("score", F.round("score", 1))


def is_finite(values: tuple[float, ...]) -> bool:
    return bool(np.isfinite(values).all())
