import hashlib

import pytest
from pyspark.sql import functions as F

from semproxy.config import ClusterOptions
from semproxy.functions.scoring import ProxyModel
from semproxy.operators.sampling import (
    ClusterSampler,
    RandomSampler,
    sample_random,
    select_uncertain,
    subset_representatives,
)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def expected_sample(names, budget, seed):
    def key(name):
        return (hashlib.md5(f"{seed}:{name}".encode()).hexdigest(), name)

    return sorted(sorted(names, key=key)[:budget])


def test_random_sample_is_seed_stable(spark, blobs):
    names = [f"r{i}" for i in range(300)]
    for seed in (1, 42):
        assert ids(sample_random(blobs, 25, seed)) == expected_sample(names, 25, seed)
    shuffled = blobs.repartition(11)
    assert ids(sample_random(shuffled, 25, 42)) == expected_sample(names, 25, 42)
    assert len(ids(sample_random(blobs, 1000, 42))) == 300


def test_random_sample_skips_null_ids(spark, blobs):
    holes = blobs.withColumn("id", F.when(F.col("shard") > 0, F.col("id")))
    assert None not in {r["id"] for r in sample_random(holes, 300, 1).collect()}
    assert sample_random(holes, 300, 1).count() == 200


def test_uncertainty_centres(spark):
    rows = [("middle", [0.0]), ("near-low", [-1.3862944]), ("near-high", [1.3862944])]
    pool = spark.createDataFrame(rows, "id string, embedding array<float>")
    model = ProxyModel((1.0,), 0.0)
    assert ids(select_uncertain(pool, model, 1)) == ["middle"]
    assert ids(select_uncertain(pool, model, 2, 0.2, 0.8)) == ["near-high", "near-low"]


def test_ties_compare_ids_as_strings(spark):
    pool = spark.createDataFrame(
        [(name, [0.0]) for name in ("2", "10", "1")], "id string, embedding array<float>"
    )
    assert ids(select_uncertain(pool, ProxyModel((1.0,), 0.0), 2)) == ["1", "10"]


def test_subset_of_representatives(spark):
    found = spark.createDataFrame([(f"rep-{i}",) for i in range(6)], "id string")
    two = ids(subset_representatives(found, 2, 42))
    assert len(two) == 2 and two == ids(subset_representatives(found, 2, 42))
    assert len(ids(subset_representatives(found, 6, 42))) == 6


def test_shard_quotas(blobs):
    chosen = sample_random(blobs, 11, 42, "shard", (2, 0, 1)).collect()
    per_shard = {s: sum(r["shard"] == s for r in chosen) for s in range(3)}
    assert per_shard == {2: 4, 0: 4, 1: 3}


def test_samplers(blobs):
    assert RandomSampler().select_initial(blobs, 10, 1).partition is None
    selection = ClusterSampler(ClusterOptions(12, 5)).select_initial(blobs, 5, 42)
    assert selection.ids.count() == 5 and selection.partition.clusters == 12
    again = ClusterSampler(ClusterOptions(12, 5)).select_initial(blobs, 5, 42)
    assert ids(selection.ids) == ids(again.ids)
    empty = ClusterSampler().select_initial(blobs.limit(0), 5, 42)
    assert empty.ids.count() == 0 and empty.partition is None


@pytest.mark.parametrize("name", ["cluster_count", "max_iterations"])
def test_zero_cluster_options(name):
    with pytest.raises(ValueError):
        ClusterSampler(ClusterOptions(**{name: 0}))
