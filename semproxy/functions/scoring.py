"""Scoring and routing as column expressions; all of them also work on streams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACCEPT = "accept"
REJECT = "reject"
ESCALATE = "escalate"

# Labeler rates in calls per second.
LABELER_RATES = {"hosted": 75, "server": 250, "inprocess": 1800}

MODEL_SCHEMA = "run_id string, weights array<double>, intercept double"


@dataclass(frozen=True)
class ProxyModel:
    """A logistic-regression proxy: weights and intercept."""

    weights: tuple[float, ...]
    intercept: float

    def to_df(self, spark: SparkSession, run_id: str = "") -> DataFrame:
        return spark.createDataFrame(
            [(run_id, list(self.weights), float(self.intercept))], MODEL_SCHEMA
        )


def stable_sigmoid(z: Column) -> Column:
    """Logistic function that never exponentiates a positive number."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def probability(embedding: Column, weights: Column, intercept: Column) -> Column:
    """Probability of label 1 by the model in other columns of the row; an embedding of another
    width is an error."""
    products = F.zip_with(embedding, weights, lambda x, w: x.cast("double") * w)
    total = F.aggregate(products, intercept, lambda total, p: total + p, stable_sigmoid)
    return F.when(F.size(embedding) == F.size(weights), total).otherwise(
        F.raise_error(F.lit("embedding width differs from the model width")).cast("double")
    )


def predict_probability(embedding: Column, model: ProxyModel) -> Column:
    """Probability of label 1; an embedding of another width is an error."""
    weights = F.lit(np.asarray(model.weights, dtype=np.float64))
    products = F.zip_with(embedding, weights, lambda x, w: x.cast("double") * w)
    probability = F.aggregate(
        products, F.lit(float(model.intercept)), lambda total, p: total + p, stable_sigmoid
    )
    width = len(model.weights)
    return F.when(F.size(embedding) == width, probability).otherwise(
        F.raise_error(F.lit(f"embedding width differs from the model width {width}")).cast("double")
    )


def batch_probabilities(embedding: Column, models: list[ProxyModel]) -> Column:
    """Probabilities of all ``models`` as one array, by one matrix product per batch of rows."""
    weights = np.array([m.weights for m in models], np.float64).T
    intercepts = np.array([m.intercept for m in models], np.float64)
    width = len(weights)

    @F.arrow_udf("array<double>")
    def score(embeddings: pa.Array) -> pa.Array:
        values = embeddings.flatten()
        widths = pc.unique(pc.list_value_length(embeddings)).to_pylist()
        if set(widths) - {width} or values.null_count:
            raise ValueError(f"embedding width differs from the model width {width}, or holds NULL")
        points = values.to_numpy(zero_copy_only=False).reshape(len(embeddings), width)
        z = points.astype(np.float64) @ weights + intercepts
        e = np.exp(-np.abs(z))
        p = np.where(z >= 0, 1 / (1 + e), e / (1 + e))
        places = np.arange(len(p) + 1, dtype=np.int32) * len(intercepts)
        return pa.ListArray.from_arrays(pa.array(places), pa.array(p.ravel()))

    return score(embedding)


def squared_distance(left: Column, right: Column) -> Column:
    """Sum of squared differences of two arrays of one width."""
    squares = F.zip_with(
        left,
        right,
        lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")),
    )
    return F.aggregate(squares, F.lit(0.0), lambda total, s: total + s)


def seeded_key(id_col: Column, seed: int) -> Column:
    """Seed-stable pseudo-random sort key of an id, independent of partitions."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col))


def uncertainty(score: Column, center_1: float = 0.5, center_2: float = 0.5) -> Column:
    """Distance of a score to the nearer uncertainty centre."""
    if center_1 == center_2:
        return F.abs(score - F.lit(center_1))
    return F.least(F.abs(score - F.lit(center_1)), F.abs(score - F.lit(center_2)))


def confidence(score: Column) -> Column:
    return F.abs(score - F.lit(0.5))


def predicted_label(score: Column) -> Column:
    return F.when(score >= 0.5, 1).otherwise(0)


def zone(score: Column, reject: float, accept: float) -> Column:
    """Three-zone routing; both bounds belong to their zone and reject is tested first."""
    return (
        F.when(score <= F.lit(reject), REJECT)
        .when(score >= F.lit(accept), ACCEPT)
        .otherwise(ESCALATE)
    )


def projected_latency(calls: Column) -> dict[str, Column]:
    """Seconds that ``calls`` labeler calls take at each known rate."""
    return {name: calls / F.lit(float(rate)) for name, rate in LABELER_RATES.items()}
