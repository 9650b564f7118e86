import numpy as np
import pytest
from pyspark.sql import functions as F

from semproxy.operators import logistic
from semproxy.operators.logistic import Settings, Sums, fit_arrays
from semproxy.operators.training import LogisticTrainer
from tests.conftest import EXAMPLES


def invented(seed, n, width, noise=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    y = (x @ rng.normal(size=width) + noise * rng.normal(size=n) > 0).astype(float)
    return x, y


def slope(x, y, point, l2):
    sums = Sums.of(x, y, point, False)
    return (sums.gradient + l2 * np.concatenate([[0], point[1:]])) / len(y)


@pytest.mark.parametrize("n,width", [(400, 3), (400, 40), (30, 200), (300, 900)])
@pytest.mark.parametrize("l2", [0.5, 5.0])
def test_the_gradient_vanishes(n, width, l2):
    x, y = invented(n + width, n, width)
    point = fit_arrays(x, y, Settings(l2, 500, 1e-14, False))
    assert np.abs(slope(x, y, point, l2)).max() < 1e-6


def test_quasi_newton_agrees_with_newton(monkeypatch):
    x, y = invented(3, 500, 20)
    newton = fit_arrays(x, y, Settings(1.0, 200, 1e-14, False))
    monkeypatch.setattr(logistic, "CURVATURE_BYTES", 0)
    assert np.allclose(newton, fit_arrays(x, y, Settings(1.0, 500, 1e-14, False)), atol=1e-4)


def test_rows_that_a_plane_parts_stay_finite():
    x, y = invented(5, 40, 64, 0.0)
    for settings in (Settings(0.0, 100, 1e-6, False), Settings(0.0, 100, 1e-6, True)):
        point = fit_arrays(x, y, settings)
        assert np.isfinite(point).all()
        assert (((x @ point[1:] + point[0]) > 0) == (y > 0)).all()


def test_standardising_weighs_the_penalty_by_the_variance():
    x, y = invented(7, 300, 4)
    x *= np.array([1.0, 10.0, 0.1, 3.0])
    point = fit_arrays(x, y, Settings(2.0, 200, 1e-14, True))
    spread = x.std(axis=0, ddof=1)
    turned = fit_arrays(x / spread, y, Settings(2.0, 200, 1e-14, False))
    assert np.allclose(point[1:] * spread, turned[1:], atol=1e-6)


def many(spark, groups=7):
    rows = []
    for g in range(groups):
        x, y = invented(100 + g, 40 + 30 * g, 3)
        rows += [(f"g{g}", f"{g}-{i}", [float(v) for v in a], int(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, f"key string, {EXAMPLES}").repartition(5).cache()


def jobs_of(spark, name, work):
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        work()
        return len(context.statusTracker().getJobIdsForGroup(name))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("size", [logistic.FIT_BYTES, 2000])
def test_many_models_equal_single_ones(spark, monkeypatch, size):
    """Also where some models are fitted in a task and others by passes over the written rows."""
    rows = many(spark)
    trainer = LogisticTrainer(l2=1.0, tol=1e-12)
    single = {f"g{g}": trainer.fit(rows.where(F.col("key") == f"g{g}")) for g in range(7)}
    monkeypatch.setattr(logistic, "FIT_BYTES", size)
    together = trainer.fit_groups(rows)
    assert {key: n for key, (_, n) in together.items()} == {f"g{g}": 40 + 30 * g for g in range(7)}
    for key, (model, _) in together.items():
        assert np.allclose(model.weights, single[key].weights, atol=1e-6)
        assert np.isclose(model.intercept, single[key].intercept, atol=1e-6)


def test_sums_are_added_in_levels(spark, monkeypatch):
    rows = many(spark)
    trainer = LogisticTrainer(l2=1.0, tol=1e-12, standardize=True)
    want = trainer.fit_groups(rows)
    monkeypatch.setattr(logistic, "FIT_BYTES", 500)
    monkeypatch.setattr(logistic, "FAN_IN", 2)
    for curvature in (logistic.CURVATURE_BYTES, 0):
        monkeypatch.setattr(logistic, "CURVATURE_BYTES", curvature)
        found = trainer.fit_groups(rows)
        for key, (model, _) in want.items():
            assert np.allclose(found[key][0].weights, model.weights, atol=1e-4)


@pytest.mark.parametrize("size", [logistic.FIT_BYTES, 500])
def test_jobs_do_not_grow_with_the_models(spark, monkeypatch, size):
    monkeypatch.setattr(logistic, "FIT_BYTES", size)
    rows = many(spark, 12)
    rows.count()
    trainer = LogisticTrainer(l2=1.0, max_iter=5)
    few = jobs_of(spark, f"few{size}", lambda: trainer.fit_groups(rows.where("key in ('g0', 'g1')")))
    all_ = jobs_of(spark, f"all{size}", lambda: trainer.fit_groups(rows))
    assert 0 < few and all_ <= few + 1


def test_one_class_among_others(spark):
    rows = many(spark).unionByName(spark.createDataFrame([("one", "x", [1.0, 2.0, 3.0], 1)], f"key string, {EXAMPLES}"))
    found = LogisticTrainer(l2=1.0).fit_groups(rows)
    assert found["one"][0].weights == (0.0, 0.0, 0.0) and found["one"][1] == 1
    assert len(found) == 8
