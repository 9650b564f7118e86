"""The paths taken beyond the size bounds give the same results as the small ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from semproxy import session
from semproxy.config import ClusterOptions, RunConfig
from semproxy.operators import clustering, logistic, topk, training
from semproxy.operators.clustering import AssignmentTable, CentroidPartition
from semproxy.operators.labeling import GoldLabeler, exclude_labeled, fetch_by_ids
from semproxy.operators.propagation import ClusterPropagation
from semproxy.operators.training import LogisticTrainer
from semproxy.plans.presets import STRATEGIES
from semproxy.plans.runner import run_proxy_training
from semproxy.session import BROADCAST_BYTES, ID_BYTES, small
from semproxy.sources import candidates


@pytest.fixture
def no_bounds(monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(logistic, "FIT_BYTES", 200)
    monkeypatch.setattr(topk, "SORTED_ROWS", 0)
    monkeypatch.setattr(clustering, "CHUNK_BYTES", 64)
    monkeypatch.setattr(candidates, "PUSHED_IDS", 0)
    monkeypatch.setattr(clustering, "CENTROID_BYTES", 0)


def run(blobs, name):
    strategy = STRATEGIES[name]
    shards = {"shard_col": "shard", "shards": (0, 1, 2)} if strategy.sharded else {}
    config = RunConfig(
        rounds=2,
        label_budget=18,
        initial_label_fraction=0.5,
        placement=strategy.placement,
        **shards,
    )
    return run_proxy_training(
        blobs,
        config,
        strategy.sampler(ClusterOptions(6, 2)),
        GoldLabeler(blobs.select("id", "label")),
        strategy.builder(),
        LogisticTrainer(l2=1.0, max_iter=15),
    )


@pytest.mark.parametrize("name", ["recursive", "lc2rec"])
def test_run_beyond_the_bounds(blobs, name, request):
    usual = run(blobs, name)
    request.getfixturevalue("no_bounds")
    large = run(blobs, name)
    assert np.allclose(usual.model.weights, large.model.weights, atol=1e-6)
    ids = [sorted(r["id"] for r in result.ledger.collect()) for result in (usual, large)]
    assert ids[0] == ids[1]


def test_broadcasts_follow_the_bound(spark, blobs):
    few = blobs.select("id").limit(3)

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert "strategy=broadcast" in plan(fetch_by_ids(blobs, few, 3))
    most = BROADCAST_BYTES // ID_BYTES
    assert "strategy=broadcast" in plan(exclude_labeled(blobs, few, most))
    assert "strategy=broadcast" not in plan(fetch_by_ids(blobs, few, most + 1))
    assert "strategy=broadcast" not in plan(fetch_by_ids(blobs, few))
    assert "strategy=broadcast" not in plan(blobs.join(small(few, 1000, BROADCAST_BYTES), "id"))


def test_small_selections_are_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(i, f"text {i}", [float(i)]) for i in range(100)]
    spark.createDataFrame(rows, "id long, text string, embedding array<float>").write.parquet(path)
    table = spark.read.parquet(path)
    ids = spark.createDataFrame([("7",), ("42",)], "id string")
    found = candidates.fetch_candidates(table, ids, 2)
    assert "PushedFilters: [In(id, [" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["id"] for r in found.collect()) == ["42", "7"]
    joined = candidates.fetch_candidates(table, ids, candidates.PUSHED_IDS + 1)
    assert sorted(map(str, joined.collect())) == sorted(map(str, found.collect()))


def test_fit_keeps_the_partitions_of_the_scan(spark, blobs):
    """The pool is assigned in all its partitions, the covered rows are shuffled after that."""
    partition = CentroidPartition({0: ([0, 1], np.array([[1.0, 0.0], [-1.0, 0.0]]))})
    pool = blobs.repartition(7)
    built = ClusterPropagation().build(blobs.where("id in ('r1', 'r2')"), pool, partition)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and built.rdd.getNumPartitions() == 7


def test_fit_does_not_depend_on_the_layout(blobs, monkeypatch):
    rows = blobs.select("id", "embedding", "label")
    models = []
    for size in (session.FIT_BYTES, 500):
        monkeypatch.setattr(logistic, "FIT_BYTES", size)
        models += [LogisticTrainer(l2=1.0).fit(rows.repartition(n)).weights for n in (1, 9)]
    assert all(np.allclose(models[0], m, atol=1e-9) for m in models)
    assert models[0] == models[1]


def test_clusters_as_table_or_centres(blobs):
    centers = CentroidPartition({0: ([0, 1], np.array([[1.0, 0.0], [-1.0, 0.0]]))})
    table = AssignmentTable(centers.assign(blobs).select("id", "cluster"))
    direct = blobs.where("id in ('r1', 'r2', 'r3', 'r4')")
    built = [
        {r["id"]: r["label"] for r in ClusterPropagation().build(direct, blobs, p).collect()}
        for p in (centers, table)
    ]
    assert built[0] == built[1] and built[0]


def test_copies_of_one_row(spark):
    """A third of the rows are copies lying between two centres: ties go to the first one."""
    rows = [(f"c{i}", [0.0, 0.0]) for i in range(3000)]
    rows += [(f"r{i}", [float(i % 7 - 3), 1.0]) for i in range(6000)]
    pool = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(8)
    centers = np.array([[2.0, 0.0], [-2.0, 0.0], [-2.0, 0.0]])
    found = CentroidPartition({0: ([0, 1, 2], centers)}).assign(pool)
    counts = {r["cluster"]: r["count"] for r in found.groupBy("cluster").count().collect()}
    left = sum(i % 7 - 3 < 0 for i in range(6000))
    assert counts == {0: 9000 - left, 1: left}
    assert found.where(F.col("id").startswith("c")).agg(F.max("distance")).first()[0] == 4.0


def test_bad_embeddings_fail_in_assignment(spark):
    partition = CentroidPartition({0: ([0], np.zeros((1, 2)))})
    for bad in (None, [1.0], [1.0, None], [1.0, 2.0, 3.0]):
        rows = [("a", [1.0, 2.0]), ("b", bad)]
        pool = spark.createDataFrame(rows, "id string, embedding array<float>").coalesce(1)
        with pytest.raises(Exception, match="embeddings must hold"):
            partition.assign(pool).collect()


def clusters_of(partition, pool):
    return {r["id"]: r["cluster"] for r in partition.assign(pool).select("id", "cluster").collect()}


def test_scale_of_the_vectors_does_not_matter(blobs):
    pool = blobs.select("id", "embedding")
    options = ClusterOptions(5, 30)
    usual = clusters_of(clustering.kmeans_partition(pool, options, 42), pool)
    for scale in (2.0**-17, 2.0**20):
        scaled = pool.withColumn("embedding", F.transform("embedding", lambda x: (x * scale).cast("float")))
        assert clusters_of(clustering.kmeans_partition(scaled, options, 42), scaled) == usual


def test_copies_cost_no_centres(spark):
    rows = [(f"c{i}", [0.0, 0.0]) for i in range(900)] + [(f"r{i}", [float(i), 1.0]) for i in range(100)]
    pool = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(4)
    for k, expected in ((50, 50), (200, 101)):
        partition = clustering.kmeans_partition(pool, ClusterOptions(k, 5), 42)
        found = clustering.cluster_representatives(partition.assign(pool)).collect()
        assert len(found) == expected


def test_empty_centres_move_to_far_rows(spark):
    rows = [(f"a{i}", [float(i % 3)]) for i in range(30)] + [("far", [100.0]), ("further", [1000.0])]
    pool = spark.createDataFrame(rows, "id string, embedding array<float>").withColumn("s", F.lit("one"))
    centers = {"one": ([0, 1, 2], np.array([[1.0], [-50.0], [-60.0]]))}
    clustering._reseeded(pool, "s", centers, {"one": [1, 2]})
    assert centers["one"][1].ravel().tolist() == [1.0, 1000.0, -60.0]


@pytest.mark.parametrize("shards", [("eu", "us"), (1 << 40, (1 << 40) + 1)])
def test_shards_of_any_type(blobs, shards):
    table = blobs.withColumn("place", F.when(F.col("shard") == 0, F.lit(shards[0])).otherwise(F.lit(shards[1])))
    for name in ("lc2rec", "lc4", "random_sharded"):
        strategy = STRATEGIES[name]
        config = RunConfig(
            rounds=2 if strategy.recursive else 1, label_budget=16, initial_label_fraction=0.5,
            placement=strategy.placement, shard_col="place", shards=shards,
        )
        result = run_proxy_training(
            table, config, strategy.sampler(ClusterOptions(8, 2)),
            GoldLabeler(table.select("id", "label")), strategy.builder(), LogisticTrainer(l2=1.0),
        )
        counts = {r["place"]: r["count"] for r in result.ledger.groupBy("place").count().collect()}
        assert counts == {shards[0]: 8, shards[1]: 8}


def test_pool_scans_do_not_grow_with_shards(spark, blobs):
    """One job writes the rows of all shards; each fit reads its own folder."""
    scans = spark.sparkContext.accumulator(0)

    def seen(batches):
        scans.add(1)
        yield from batches

    pool = blobs.select("id", "embedding", "label", "shard").repartition(4)
    watched = pool.mapInArrow(seen, pool.schema)
    training.federated_train(watched, "shard", (0, 1, 2), LogisticTrainer(l2=1.0, max_iter=5))
    assert scans.value == 4
