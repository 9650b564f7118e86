import random

import pytest
from pyspark.sql import functions as F

from semproxy.operators import topk
from semproxy.operators.prefix import running_totals
from semproxy.operators.sampling import sample_random
from semproxy.operators.topk import place_of_hex, place_of_share, top_k, top_k_per_group

def order():
    return [F.col("s").asc(), F.col("id").asc()]



@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    # Most rows share one score and one group.
    return [
        (str(i), rng.choice([0.5, 0.5, 0.5, rng.random()]), rng.choice([0, 0, 0, 1, 2]), i % 2)
        for i in range(3000)
    ]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id string, s double, g int, c int").repartition(13).cache()


@pytest.mark.parametrize("partitions", [1, 8, 40])
def test_running_totals(table, rows, partitions):
    got = running_totals(
        table.withColumn("one", F.lit(1)), order(), ["one", "c"], partitions=partitions
    )
    found = {r["id"]: (r["run_one"], r["run_c"], r["total_one"]) for r in got.collect()}
    correct = 0
    for rank, row in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1):
        correct += row[3]
        assert found[row[0]] == (rank, correct, len(rows))


@pytest.mark.parametrize("max_groups", [None, 3])
def test_running_totals_per_group(table, rows, max_groups):
    got = running_totals(table, order(), ["c"], ["g"], max_groups).collect()
    found = {r["id"]: (r["run_c"], r["total_c"]) for r in got}
    assert len(got) == len(rows)
    for g in range(3):
        mine = sorted((r for r in rows if r[2] == g), key=lambda r: (r[1], r[0]))
        correct, total = 0, sum(r[3] for r in mine)
        for row in mine:
            correct += row[3]
            assert found[row[0]] == (correct, total)


def test_hot_value_spreads_over_partitions(table):
    from semproxy.operators import prefix

    seen = {}
    original = prefix.cut_lineage
    try:
        prefix.cut_lineage = lambda df: seen.setdefault("df", original(df))
        running_totals(table, order(), ["c"], partitions=16)
    finally:
        prefix.cut_lineage = original
    sizes = [r["count"] for r in seen["df"].groupBy("_part").count().collect()]
    assert max(sizes) < 3000 / 4


@pytest.mark.parametrize("limit", [topk.SORTED_ROWS, 1])
@pytest.mark.parametrize("k", [1, 17, 2999, 5000])
def test_top_k(table, rows, monkeypatch, limit, k):
    monkeypatch.setattr(topk, "SORTED_ROWS", limit)
    expected = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))][:k]
    got = top_k(table, order(), k, place_of_share(F.col("s"))).collect()
    assert sorted(r["id"] for r in got) == sorted(expected)


@pytest.mark.parametrize("limit", [topk.SORTED_ROWS, 1])
def test_top_k_per_group(table, rows, monkeypatch, limit):
    monkeypatch.setattr(topk, "SORTED_ROWS", limit)
    quotas = {0: 5, 1: 4, 2: 0, 9: 3}
    place = place_of_share(F.col("s"))
    got = top_k_per_group(table, "g", order(), quotas, place).collect()
    for g, quota in quotas.items():
        mine = sorted((r for r in rows if r[2] == g), key=lambda r: (r[1], r[0]))[:quota]
        assert sorted(r["id"] for r in got if r["g"] == g) == sorted(r[0] for r in mine)
    assert top_k_per_group(table, "g", order(), {0: 0}, place).count() == 0


@pytest.mark.parametrize("partitions", [8, 10_000])
@pytest.mark.parametrize("k", [200, 1001, 100_000])
def test_one_plan_for_every_budget(spark, k, partitions):
    """Rows before the last place are filtered and only that place is sorted, whatever the size."""
    pool = spark.range(200_000).select(F.col("id").cast("string").alias("id"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        chosen = sample_random(pool, k, 42)
        plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    below, last = plan.split("+- ", 1)[0], plan.split("Sort [")
    assert plan.count("Union") == 1 and len(last) == 2
    # What is ordered is filtered to a single place first.
    places = [line for line in last[1].splitlines() if "Filter" in line and "16, 10" in line]
    assert len(places) == 1 and ") = " in places[0], below


def test_places_follow_the_order(spark):
    values = [0.0, 1e-9, 0.2, 0.2000001, 0.99999, 1.0, None, float("nan")]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    places = [r[0] for r in rows.select(place_of_share(F.col("v"))).collect()]
    assert places == sorted(places) and places[-1] == topk.PLACES - 1
    keys = spark.createDataFrame([(k,) for k in ("0000a", "00ff0", "ffff9")], "k string")
    assert [r[0] for r in keys.select(place_of_hex(F.col("k"))).collect()] == [0, 255, 65535]
