import numpy as np
import pytest
from pyspark.sql import functions as F

from registry.queries import QUERIES
from semproxy.config import ClusterOptions
from semproxy.operators import clustering
from semproxy.operators.clustering import (
    CentroidPartition,
    cluster_representatives,
    kmeans_partition,
    sharded_kmeans,
)


def brute(points, centers):
    distance = ((points[:, None, :] - centers[None]) ** 2).sum(2)
    return distance.argmin(1), distance.min(1)


def test_nearest_against_brute_force(blobs):
    centers = np.array([[1.0, 1.0], [-1.0, 1.0], [1.0, 1.0], [0.0, -1.0]])
    partition = CentroidPartition({0: ([0, 1, 2, 3], centers)})
    rows = partition.assign(blobs.select("id", "embedding")).collect()
    points = np.array([r["embedding"] for r in rows], np.float64)
    cluster, distance = brute(points, centers)
    assert [r["cluster"] for r in rows] == cluster.tolist()
    assert np.allclose([r["distance"] for r in rows], distance)
    assert 2 not in cluster


def test_representatives(blobs):
    centers = np.array([[1.0, 1.0], [-1.0, -1.0], [9.0, 9.0]])
    rows = CentroidPartition({0: ([0, 1, 2], centers)}).assign(blobs)
    found = {r["cluster"]: r["id"] for r in cluster_representatives(rows).collect()}
    best = {}
    for r in rows.collect():
        best.setdefault(r["cluster"], []).append((r["distance"], r["id"]))
    assert found == {c: min(members)[1] for c, members in best.items()}
    assert 2 not in found


def test_representative_ties_go_to_the_smaller_id(spark):
    pool = spark.createDataFrame(
        [("2", [1.0]), ("10", [1.0]), ("3", [-1.0])], "id string, embedding array<float>"
    )
    rows = CentroidPartition({0: ([0], np.array([[0.0]]))}).assign(pool)
    assert cluster_representatives(rows).first()["id"] == "10"


def test_kmeans_clamps(spark, blobs):
    assert kmeans_partition(blobs.limit(0), ClusterOptions(3, 2), 1) is None
    one = kmeans_partition(blobs, ClusterOptions(1, 2), 1)
    mean = np.mean([r["embedding"] for r in blobs.collect()], axis=0)
    assert one.clusters == 1 and np.allclose(one.centers[0][1][0], mean)
    few = blobs.where(F.col("id").isin("r1", "r2", "r3"))
    assert kmeans_partition(few, ClusterOptions(50, 2), 1).clusters <= 3
    same = spark.createDataFrame(
        [(str(i), [float(i % 2)]) for i in range(9)], "id string, embedding array<float>"
    )
    duplicates = kmeans_partition(same, ClusterOptions(5, 2), 1)
    assert 1 <= duplicates.clusters <= 5
    used = duplicates.assign(same).select("cluster").distinct().count()
    assert used == 2
    assert duplicates.assign(same).count() == 9


def test_kmeans_over_the_whole_table(blobs):
    for table in (blobs, blobs.repartition(7)):
        partition = kmeans_partition(table, ClusterOptions(9, 10), 42)
        assert partition.keys == ("cluster",)
        assert np.allclose(partition.centers[0][1], lloyd(blobs.collect(), 9, 10, 42))


def lloyd(rows, k, steps, seed):
    """The same passes in numpy for one shard."""
    import hashlib

    def key(row):
        return (hashlib.md5(f"{seed}:{row['id']}".encode()).hexdigest(), row["id"])

    points = np.array([r["embedding"] for r in rows], np.float64)
    centers = np.array([r["embedding"] for r in sorted(rows, key=key)[:k]], np.float64)
    for _ in range(steps):
        cluster, _ = brute(points, centers)
        moved = centers.copy()
        for c in set(cluster.tolist()):
            moved[c] = points[cluster == c].mean(0)
        if np.abs(moved - centers).max() < 1e-4:
            break
        centers = moved
    return centers


@pytest.mark.parametrize("limit", [clustering.CENTROID_BYTES, 1])
def test_sharded_kmeans(blobs, monkeypatch, limit):
    monkeypatch.setattr(clustering, "CENTROID_BYTES", limit)
    partition = sharded_kmeans(blobs, "shard", (0, 1, 2), ClusterOptions(5, 3), 42)
    rows = blobs.collect()
    for shard in range(3):
        mine = [r for r in rows if r["shard"] == shard]
        assert np.allclose(partition.centers[shard][1], lloyd(mine, 5, 3, 42))
    assert partition.assign(blobs).count() == 300


def test_one_shard_equals_the_whole_table(blobs):
    whole = blobs.withColumn("shard", F.lit(0))
    partition = sharded_kmeans(whole, "shard", (0,), ClusterOptions(4, 3), 42)
    assert np.allclose(partition.centers[0][1], lloyd(blobs.collect(), 4, 3, 42))


def test_small_shards(blobs):
    partition = sharded_kmeans(
        blobs.where("shard > 0 or id = 'r0'"), "shard", (0, 1, 7), ClusterOptions(4, 2), 42
    )
    assert {s: len(names) for s, (names, _) in partition.centers.items()} == {0: 1, 1: 4}
    assert sharded_kmeans(blobs.limit(0), "shard", (0,), ClusterOptions(4, 2), 42) is None


def test_assignment_runs_once(blobs):
    """A join on the cluster must not evaluate the function a second time."""
    rows = CentroidPartition({0: ([0], np.zeros((1, 2)))}).assign(blobs)
    votes = blobs.sparkSession.createDataFrame([(0, 1)], "cluster int, positives int")
    plan = rows.join(F.broadcast(votes), "cluster")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.fixture(scope="module")
def islands(spark):
    """Forty dense groups of very different size."""
    rng = np.random.default_rng(17)
    rows = []
    for group in range(40):
        middle = rng.normal(0, 20, 6)
        for i in range(4 if group % 4 else 60):
            rows.append((f"{group}-{i}", [float(x) for x in middle + rng.normal(0, 0.3, 6)], group % 2))
    return spark.createDataFrame(rows, "id string, embedding array<float>, shard int").repartition(5).cache()


def inertia(partition, pool):
    return partition.assign(pool).agg(F.sum("distance")).first()[0]


def test_oversampled_starts_find_small_groups(islands):
    pool = islands.select("id", "embedding")
    seeded = inertia(kmeans_partition(pool, ClusterOptions(40, 10), 3), pool)
    spread = kmeans_partition(pool, ClusterOptions(40, 10, start="oversampled"), 3)
    assert spread.clusters == 40
    assert inertia(spread, pool) < 0.5 * seeded
    again = kmeans_partition(pool.repartition(9), ClusterOptions(40, 10, start="oversampled"), 3)
    assert np.allclose(spread.centers[0][1], again.centers[0][1])


def test_oversampled_starts_per_shard_and_with_few_rows(islands):
    options = ClusterOptions(20, 5, start="oversampled")
    found = sharded_kmeans(islands, "shard", (0, 1, 2), options, 5)
    assert {shard: len(names) for shard, (names, _) in found.centers.items()} == {0: 20, 1: 20}
    pair = islands.where("id IN ('1-0', '1-1')").select("id", "embedding")
    copies = pair.unionByName(pair.select(F.concat("id", F.lit("-copy")).alias("id"), "embedding"))
    two = kmeans_partition(copies, ClusterOptions(9, 3, start="oversampled"), 5)
    assert two.clusters == 2 and inertia(two, copies) < 1e-9
    assert kmeans_partition(copies.where("false"), options, 5) is None
    with pytest.raises(ValueError):
        ClusterOptions(start="other")


def test_copies_query_returns_the_representatives(spark, tmp_path):
    """Each cluster's row nearest its centre, also where fewer vectors differ than are asked for."""
    rng = np.random.default_rng(4)
    for name, distinct in (("few", 20), ("many", 120)):
        vectors = rng.normal(size=(distinct, 3)).tolist()
        rows = [(i, vectors[i % distinct]) for i in range(240)]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        found = QUERIES["kmeans_copies"](spark, f"{tmp_path}/{name}").collect()
        clusters = min(distinct, 50)
        assert sorted(r["cluster"] for r in found) == list(range(clusters))
        assert len({int(r["id"].split("-")[1]) % distinct for r in found}) == clusters
        assert sum(r["in_cluster"] for r in found) == 1200
        assert {(r["clusters"], r["n_rows"], r["parted"]) for r in found} == {(clusters, 1200, 0)}
        if name == "few":
            assert {r["in_cluster"] for r in found} == {60}
            ids = [f"{copy}-{i}" for copy in range(5) for i in range(240)]
            least = {of: min(x for x in ids if int(x[2:]) % distinct == of) for of in range(distinct)}
            assert {r["id"] for r in found} == set(least.values())
