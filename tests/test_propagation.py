import pytest
from pyspark.sql import functions as F

from semproxy.operators.clustering import AssignmentTable
from semproxy.operators.propagation import ClusterPropagation, DirectLabels, cluster_votes


@pytest.fixture(scope="module")
def fixture(spark):
    pool = spark.createDataFrame(
        [("a", [1.0]), ("b", [2.0]), ("c", [3.0]), ("d", [4.0])],
        "id string, embedding array<float>",
    )
    labels = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "id string, label int")
    clusters = spark.createDataFrame(
        [("a", 0), ("b", 0), ("c", 1), ("d", 2)], "id string, cluster int"
    )
    return pool, pool.join(labels, "id"), AssignmentTable(clusters)


def test_propagation_overrides_and_omits(fixture):
    pool, direct, clusters = fixture
    built = ClusterPropagation().build(direct, pool, clusters)
    assert {r["id"]: r["label"] for r in built.collect()} == {"a": 1, "b": 1, "c": 1}


def test_direct_labels_stay(fixture):
    pool, direct, _ = fixture
    built = DirectLabels().build(direct, pool, None)
    assert {r["id"]: r["label"] for r in built.collect()} == {"a": 0, "b": 1, "c": 1}


def test_propagation_needs_clusters(fixture):
    pool, direct, _ = fixture
    with pytest.raises(ValueError):
        ClusterPropagation().build(direct, pool, None)


def test_anything_but_one_is_negative(spark):
    rows = [(0, 1), (0, 2), (0, 0), (0, None)]
    labeled = spark.createDataFrame(rows, "cluster int, label int")
    row = cluster_votes(labeled).first()
    assert (row["positives"], row["negatives"]) == (1, 3)


def test_rows_without_assignment_are_skipped(fixture):
    pool, direct, clusters = fixture
    partial = AssignmentTable(clusters.assignments.where(F.col("id") != "b"))
    built = ClusterPropagation().build(direct, pool, partial)
    assert {r["id"]: r["label"] for r in built.collect()} == {"a": 0, "c": 1}
