import math

import pytest
from pyspark.sql import functions as F

from semproxy.config import (
    ClusterOptions,
    DatasetSpec,
    RunConfig,
    config_violations,
    initial_budget,
    recursive_budget,
    round_budgets,
    shard_budget,
    shard_quotas,
)


def test_defaults():
    config = RunConfig()
    assert (config.rounds, config.label_budget, config.initial_label_fraction) == (1, 200, 0.2)
    assert (config.uncertainty_center_1, config.uncertainty_center_2, config.seed) == (0.5, 0.5, 42)
    assert ClusterOptions() == ClusterOptions(50, 10)


@pytest.mark.parametrize(
    "settings",
    [
        {"rounds": 0},
        {"label_budget": 0},
        {"initial_label_fraction": 0.0},
        {"initial_label_fraction": 1.1},
        {"uncertainty_center_1": -0.1},
        {"uncertainty_center_2": 1.1},
        {"uncertainty_center_1": math.nan},
        {"shards": (1, 2)},
        {"shard_col": "shard"},
        {"shard_col": "shard", "shards": (1, 1)},
        {"placement": "federated"},
        {"placement": "elsewhere"},
    ],
)
def test_bad_settings(settings):
    with pytest.raises(ValueError):
        RunConfig(**settings)


def test_bad_options():
    with pytest.raises(ValueError):
        ClusterOptions(0, 10)
    with pytest.raises(ValueError):
        ClusterOptions(5, 0)
    with pytest.raises(ValueError):
        DatasetSpec("id", "", "embedding")


def test_budgets():
    assert initial_budget(RunConfig(rounds=1, label_budget=64)) == 64
    assert initial_budget(RunConfig(rounds=3, label_budget=64)) == 12
    assert initial_budget(RunConfig(rounds=3, label_budget=2)) == 1
    assert recursive_budget(10, 3) == 4
    assert shard_quotas(10, (5, 6, 7)) == {5: 4, 6: 3, 7: 3}
    assert sum(shard_quotas(2, (0, 1, 2)).values()) == 2


def test_round_table_follows_the_loop(spark):
    budgets = spark.createDataFrame([(b,) for b in (1, 2, 5, 48, 97)], "budget long")
    for rounds, fraction in ((1, 0.2), (3, 0.2), (5, 0.5), (4, 1.0)):
        rows = round_budgets(budgets, "budget", rounds, fraction).collect()
        for b in (1, 2, 5, 48, 97):
            config = RunConfig(rounds=rounds, label_budget=b, initial_label_fraction=fraction)
            asked = [initial_budget(config)]
            left = b - asked[0]
            for number in range(1, rounds):
                if left == 0:
                    break
                asked.append(recursive_budget(left, rounds - number))
                left -= asked[-1]
            got = sorted((r["round"], r["requested"]) for r in rows if r["budget"] == b)
            assert got == list(enumerate(asked))


def test_column_forms(spark):
    rows = spark.range(7).select(shard_budget(F.lit(10), F.col("id"), 7).alias("q")).collect()
    assert [r["q"] for r in rows] == [2, 2, 2, 1, 1, 1, 1]
    settings = spark.createDataFrame(
        [(1, 10, 0.2, 0.5, 0.5), (0, 0, 0.0, -0.1, 1.1), (1, 1, 1.0, math.nan, None)],
        "r int, b int, f double, c1 double, c2 double",
    )
    names = [F.col(c) for c in ("r", "b", "f", "c1", "c2")]
    found = settings.select(config_violations(*names).alias("n")).collect()
    assert [r["n"] for r in found] == [0, 5, 2]
