"""Models and score tables as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semproxy.functions.scoring import MODEL_SCHEMA, ProxyModel
from semproxy.operators.labeling import label_lookup


def write_model(spark: SparkSession, model: ProxyModel, path: str, run_id: str = "") -> None:
    model.to_df(spark, run_id).write.mode("errorifexists").parquet(path)


def read_model(spark: SparkSession, path: str, run_id: str = "") -> ProxyModel:
    row = spark.read.schema(MODEL_SCHEMA).parquet(path).where(F.col("run_id") == run_id).first()
    if row is None:
        raise ValueError(f"no model {run_id!r} at {path}")
    return ProxyModel(tuple(row["weights"]), row["intercept"])


def score_dump_join(scores: DataFrame, truth: DataFrame, path: str) -> DataFrame:
    """Write scores with the ground truth of their ids; returns the written table. A score
    without a truth is an error."""
    dump = label_lookup(scores.select("id", "score"), truth)
    dump.write.mode("errorifexists").parquet(path)
    return dump.sparkSession.read.schema(dump.schema).parquet(path)
