"""Models as a versioned table, and rows scored by the last model of their shard.

A version is one row ``(run_id, shard, round, weights, intercept)``. A row asks for a round and gets
the model of the highest round at or below it, as a worker does that keeps the last model sent to it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semproxy.functions.scoring import ProxyModel, probability
from semproxy.session import BROADCAST_BYTES

VERSIONS = "run_id string, shard string, round int, weights array<double>, intercept double"

# Bytes of a version beside its weights, reckoned with the overhead of a row.
VERSION_BYTES = 128


def model_versions(
    spark: SparkSession, models: Iterable[tuple[str, object, int, ProxyModel]]
) -> DataFrame:
    """Versions from ``(run_id, shard, round, model)``."""
    rows = [
        (run_id, str(shard), number, list(map(float, model.weights)), float(model.intercept))
        for run_id, shard, number, model in models
    ]
    return spark.createDataFrame(rows, VERSIONS)


def broadcast_versions(
    spark: SparkSession, run_id: str, shards: Iterable[object], number: int, model: ProxyModel
) -> DataFrame:
    """One model sent to every shard after a round."""
    return model_versions(spark, [(run_id, shard, number, model) for shard in shards])


def append_versions(versions: DataFrame, path: str) -> DataFrame:
    """Add versions to the table at ``path``; a version may be written only once."""
    spark = versions.sparkSession
    keys = ["run_id", "shard", "round"]
    repeated = versions.groupBy(*keys).count().where("count > 1")
    try:
        there = spark.read.schema(VERSIONS).parquet(path)
    except Exception as error:  # the first versions
        if "PATH_NOT_FOUND" not in str(error):
            raise
    else:
        repeated = repeated.select(*keys).unionByName(versions.join(there, keys, "left_semi").select(*keys))
    found = repeated.limit(1).collect()
    if found:
        raise ValueError(f"model version {tuple(found[0])[:3]} is there already")
    versions.write.mode("append").parquet(path)
    return spark.read.schema(VERSIONS).parquet(path)


def version_histories(versions: DataFrame, run_id: str) -> DataFrame:
    """``(shard, versions)``: every shard's versions of a run by round, as an array."""
    version = F.struct("round", "weights", "intercept")
    own = versions.where(F.col("run_id") == run_id)
    return own.groupBy("shard").agg(F.sort_array(F.collect_list(version)).alias("versions"))


def history_bytes(versions: DataFrame, run_id: str) -> int:
    """What the histories of a run take, from the widths of all their weights."""
    own = versions.where(F.col("run_id") == run_id)
    return own.agg(F.sum(F.size("weights") * 8 + VERSION_BYTES)).first()[0] or 0


def as_of(versions: Column, number: Column) -> Column:
    """The last version at or below a round, NULL if there is none."""
    return F.try_element_at(F.filter(versions, lambda v: v["round"] <= number), F.lit(-1))


def with_model(
    rows: DataFrame, versions: DataFrame, run_id: str, shard: str = "shard", number: str = "round"
) -> DataFrame:
    """``rows`` with ``model_round`` and ``model``, the version their shard has at their round; both
    are NULL where the shard has none yet.

    A shard's versions are one row, so a row meets at most one. They are broadcast when their
    counted bytes are few, else both sides are shuffled by shard."""
    histories = version_histories(versions, run_id).withColumnRenamed("shard", "_shard")
    if history_bytes(versions, run_id) <= BROADCAST_BYTES:
        histories = F.broadcast(histories)
    joined = rows.join(histories, F.col(shard).cast("string") == F.col("_shard"), "left")
    found = as_of(F.col("versions"), F.col(number))
    return joined.select(*rows.columns, found.alias("model")).select(
        *rows.columns, F.col("model")["round"].alias("model_round"), "model"
    )


def score_as_of(
    rows: DataFrame, versions: DataFrame, run_id: str, shard: str = "shard", number: str = "round"
) -> DataFrame:
    """``rows`` with ``model_round`` and ``score`` by :func:`with_model`; a row without a model has
    neither."""
    model = F.col("model")
    score = F.when(model.isNotNull(), probability(F.col("embedding"), model["weights"], model["intercept"]))
    found = with_model(rows, versions, run_id, shard, number)
    return found.select(*rows.columns, "model_round", score.alias("score"))
