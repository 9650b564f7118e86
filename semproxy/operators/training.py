"""Fitting the proxy, centrally or as an average of per-shard fits."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semproxy.functions.scoring import MODEL_SCHEMA, ProxyModel
from semproxy.operators.checks import example_violations, require_valid_examples
from semproxy.operators.logistic import Settings, fit_models
from semproxy.session import drop_written, scratch_path, written


@dataclass(frozen=True)
class LogisticTrainer:
    """Binary logistic regression with intercept; ``l2`` weighs the squared norm against the
    summed loss."""

    l2: float = 0.0
    max_iter: int = 100
    tol: float = 1e-6
    standardize: bool = False

    def __post_init__(self) -> None:
        if not math.isfinite(self.l2) or self.l2 < 0:
            raise ValueError("l2 must be finite and not negative")

    def for_shard(self) -> LogisticTrainer:
        """The trainer of one shard's rows, whose spread may differ from that of the others."""
        return replace(self, standardize=True)

    def fit(self, examples: DataFrame, counts: dict | None = None) -> ProxyModel:
        """Fit ``(id, embedding, label)`` rows; ``counts`` are their :func:`example_violations`
        where the caller has them already. Rows are summed in the order of their ids, whatever the
        layout they come in."""
        if counts is None:
            counts = example_violations(examples).first().asDict()
        rows = examples.select(F.lit("").alias("key"), "id", "embedding", "label")
        return self.fit_checked(rows, {"": counts})[""]

    def fit_groups(self, rows: DataFrame) -> dict[str, tuple[ProxyModel, int]]:
        """The model, and the number of rows, of every key of ``rows(key, id, embedding, label)``:
        one grouped check, then one optimiser for all of them."""
        counts = {row["key"]: row.asDict() for row in example_violations(rows, ("key",)).collect()}
        fitted = self.fit_checked(rows, counts)
        return {key: (model, counts[key]["n_rows"]) for key, model in fitted.items()}

    def fit_checked(self, rows: DataFrame, counts: dict[str, dict]) -> dict[str, ProxyModel]:
        """The models of all keys, whose ``counts`` have to be valid."""
        models, wanted = {}, {}
        for key, found in counts.items():
            require_valid_examples(found)
            n, positives, width = found["n_rows"], found["positives"], found["max_width"]
            if positives in (0, n):
                # One class has no finite optimum: a smoothed constant keeps scores finite.
                models[key] = ProxyModel((0.0,) * width, math.log((positives + 1) / (n - positives + 1)))
            else:
                wanted.setdefault(width, {})[key] = n
        settings = Settings(self.l2, self.max_iter, self.tol, self.standardize)
        for width, sizes in wanted.items():
            own = rows if len(sizes) == len(counts) else rows.where(F.col("key").isin(list(sizes)))
            for key, point in fit_models(own.select("key", "id", "embedding", "label"), sizes, width, settings).items():
                models[key] = ProxyModel(tuple(float(w) for w in point[1:]), float(point[0]))
        return models


def average_models(models: DataFrame, weighted: bool = False) -> DataFrame:
    """Average weights and intercept of ``(weights, intercept[, n_rows])`` rows, by position."""
    share = F.col("n_rows") if weighted else F.lit(1)
    positions = models.select(
        share.cast("double").alias("_share"),
        F.posexplode(F.concat(F.array("intercept"), "weights")).alias("_pos", "_value"),
    )
    means = positions.groupBy("_pos").agg(
        (F.sum(F.col("_value") * F.col("_share")) / F.sum("_share")).alias("_mean")
    )
    ordered = means.agg(F.array_sort(F.collect_list(F.struct("_pos", "_mean"))).alias("_all"))
    values = F.transform("_all", lambda item: item["_mean"])
    return ordered.select(
        F.slice(values, 2, F.size(values) - 1).alias("weights"), values[0].alias("intercept")
    )


def federated_train(
    training: DataFrame,
    shard_col: str,
    shards: tuple,
    trainer: LogisticTrainer,
    weighted: bool = False,
    parallelism: int = 4,
) -> ProxyModel:
    """One fit per shard, then the average.

    The training rows are computed once and written. A trainer with ``fit_groups`` fits all shards
    together; another one is called per shard, ``parallelism`` at a time."""
    models = shard_models(training, shard_col, shards, trainer, parallelism)
    mean = average_models(models, weighted).first()
    return ProxyModel(tuple(mean["weights"]), mean["intercept"])


def shard_models(
    training: DataFrame, shard_col: str, shards: tuple, trainer: LogisticTrainer, parallelism: int = 4
) -> DataFrame:
    """``(run_id, weights, intercept, n_rows)`` of the fit of every shard that has rows."""
    local = trainer.for_shard()
    if hasattr(local, "fit_groups"):
        named = training.where(F.col(shard_col).isin(list(shards)))
        rows = written(named.select(F.col(shard_col).cast("string").alias("key"), "id", "embedding", "label"), "training")
        models = local.fit_groups(rows)
        fitted = [
            (key, list(model.weights), model.intercept, n_rows) for key, (model, n_rows) in sorted(models.items())
        ]
    else:
        rows, fitted = _shard_by_shard(training, shard_col, shards, local, parallelism)
    if not fitted:
        raise ValueError("no training examples")
    drop_written(rows)
    return training.sparkSession.createDataFrame(fitted, f"{MODEL_SCHEMA}, n_rows bigint")


def _shard_by_shard(
    training: DataFrame, shard_col: str, shards: tuple, local: Any, parallelism: int
) -> tuple[DataFrame, list[tuple]]:
    """Fits of a trainer that knows one training set at a time, each from its shard's folder."""
    spark = training.sparkSession
    path = scratch_path(spark, "training")
    rows = training.select("id", "embedding", "label", shard_col)
    rows.write.partitionBy(shard_col).parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    checks = example_violations(rows, (shard_col,)).collect()
    counts = {row[shard_col]: row.asDict() for row in checks}

    def fit(shard: Any) -> tuple:
        model = local.fit(rows.where(F.col(shard_col) == shard), counts[shard])
        return (str(shard), list(model.weights), model.intercept, counts[shard]["n_rows"])

    present = [shard for shard in shards if shard in counts]
    if not present:
        return rows, []
    with ThreadPool(min(parallelism, len(present))) as pool:
        return rows, pool.map(inheritable_thread_target(spark)(fit), present)
