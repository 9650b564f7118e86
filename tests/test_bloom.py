import pytest
from pyspark.sql import functions as F

from semproxy import session
from semproxy.operators import bloom, labeling
from semproxy.operators.bloom import bloom_filter
from semproxy.operators.labeling import UNKNOWN, exclude_labeled, fetch_by_ids


@pytest.fixture(scope="module")
def pool(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("id-"), F.col("id")).alias("id"), F.col("id").alias("n"))
    return rows.unionByName(spark.createDataFrame([(None, -1), ("", -2)], "id string, n long")).repartition(6).cache()


def test_no_id_is_lost_and_few_others_pass(pool):
    ids = pool.where("n % 10 = 3").select("id")
    found = bloom_filter(ids, ids.count())
    passed = pool.where(found.may_hold(F.col("id")))
    assert passed.where("n % 10 = 3").count() == 2000
    assert passed.count() < 2000 + 0.03 * 18_000


def test_empty_ids(pool):
    found = bloom_filter(pool.where("false").select("id"), 0)
    assert pool.where(found.may_hold(F.col("id"))).count() == 0


@pytest.mark.parametrize("bound", [bloom.FILTER_BYTES, 0])
def test_joins_beyond_the_broadcast_bound(pool, bound, monkeypatch):
    monkeypatch.setattr(bloom, "FILTER_BYTES", bound)
    ids = pool.where("n % 7 = 1 OR n = -1").select("id")
    assert sorted(r["n"] for r in fetch_by_ids(pool, ids).collect()) == list(range(1, 20_000, 7))
    rest = {r["n"] for r in exclude_labeled(pool, ids, UNKNOWN).collect()}
    assert rest == {n for n in range(20_000) if n % 7 != 1} | {-1, -2}


def exchanged_rows(frame):
    """Rows written to the shuffles of an executed plan."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if name == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_shuffled_rows_are_near_the_ids(pool):
    ids = session.written(pool.where("n % 100 = 5").select("id"), "ids")
    assert exchanged_rows(fetch_by_ids(pool, ids)) < 3 * 200 + 400
    assert exchanged_rows(exclude_labeled(pool, ids)) < 3 * 200 + 400


def test_a_bucketed_pool_is_not_shuffled(spark, pool):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = session.bucketed(pool, "id")
        ids = session.written(pool.where("n % 100 = 5").select("id"), "ids")
        rest = exclude_labeled(kept.select("id", "n"), ids)
        assert exchanged_rows(rest) <= 200
        assert rest.count() == 20_002 - 200
        session.drop_bucketed(kept)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert not labeling.is_bucketed(pool)
