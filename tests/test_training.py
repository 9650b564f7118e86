import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from semproxy.functions.scoring import ProxyModel, predict_probability, stable_sigmoid
from semproxy.operators.training import LogisticTrainer, average_models, federated_train
from semproxy.sources.artifacts import read_model, write_model
from tests.conftest import EXAMPLES

POINTS = [
    ("negative-1", [-2.0], 0),
    ("negative-2", [-1.0], 0),
    ("positive-1", [1.0], 1),
    ("positive-2", [2.0], 1),
]


def probability(spark, model, vector):
    row = spark.createDataFrame([(vector,)], "embedding array<float>")
    return row.select(predict_probability(F.col("embedding"), model)).first()[0]


def test_four_points(spark):
    model = LogisticTrainer(l2=0.01).fit(spark.createDataFrame(POINTS, EXAMPLES))
    assert probability(spark, model, [-1.5]) < 0.5 < probability(spark, model, [1.5])


def test_partitions_do_not_matter_for_small_sets(spark, blobs):
    rows = blobs.select("id", "embedding", "label")
    models = [LogisticTrainer(l2=1.0).fit(rows.repartition(n)) for n in (1, 7)]
    assert models[0] == models[1]


def test_l2_weighs_the_summed_loss(spark, blobs):
    rows = blobs.select("id", "embedding", "label")
    model = LogisticTrainer(l2=2.0, tol=1e-12).fit(rows)
    data = rows.collect()
    x = np.array([r["embedding"] for r in data], np.float64)
    y = np.array([r["label"] for r in data])
    p = 1 / (1 + np.exp(-(x @ np.array(model.weights) + model.intercept)))
    assert np.allclose(x.T @ (p - y) + 2.0 * np.array(model.weights), 0, atol=1e-3)
    assert math.isclose((p - y).sum(), 0, abs_tol=1e-3)


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_stays_finite(spark, label):
    rows = spark.createDataFrame([("a", [1.0, 2.0], label), ("b", [0.0, 1.0], label)], EXAMPLES)
    model = LogisticTrainer().fit(rows)
    assert model.weights == (0.0, 0.0)
    assert math.isclose(model.intercept, math.log(3) if label else -math.log(3))


@pytest.mark.parametrize("l2", [-1.0, math.inf, math.nan])
def test_bad_l2(l2):
    with pytest.raises(ValueError):
        LogisticTrainer(l2=l2)


def test_width_check(spark):
    with pytest.raises(Exception, match="width"):
        probability(spark, ProxyModel((1.0, 2.0), 0.0), [1.0])


def test_sigmoid_extremes(spark):
    rows = spark.createDataFrame([(z,) for z in (-1e4, -800.0, 0.0, 800.0, 1e4)], "z double")
    got = [r[0] for r in rows.select(stable_sigmoid(F.col("z"))).collect()]
    assert got == [0.0, 0.0, 0.5, 1.0, 1.0]


def test_average(spark):
    models = spark.createDataFrame(
        [("a", [1.0, 2.0], 3.0, 1), ("b", [3.0, 6.0], 5.0, 3)],
        "run_id string, weights array<double>, intercept double, n_rows bigint",
    )
    plain = average_models(models).first()
    assert (plain["weights"], plain["intercept"]) == ([2.0, 4.0], 4.0)
    weighted = average_models(models, weighted=True).first()
    assert (weighted["weights"], weighted["intercept"]) == ([2.5, 5.0], 4.5)


def test_federated(spark, blobs):
    model = federated_train(blobs, "shard", (0, 1, 2, 9), LogisticTrainer(l2=1.0))
    single = [
        LogisticTrainer(l2=1.0, standardize=True).fit(blobs.where(F.col("shard") == s))
        for s in range(3)
    ]
    assert np.allclose(model.weights, np.mean([m.weights for m in single], axis=0))
    with pytest.raises(ValueError):
        federated_train(blobs.limit(0), "shard", (0,), LogisticTrainer())


def test_model_file(spark, tmp_path):
    model = ProxyModel((0.5, -1.25), 2.0)
    write_model(spark, model, str(tmp_path / "m"), "x")
    assert read_model(spark, str(tmp_path / "m"), "x") == model
    with pytest.raises(ValueError):
        read_model(spark, str(tmp_path / "m"), "y")
