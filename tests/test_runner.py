import numpy as np
import pytest
from pyspark.sql import functions as F

from semproxy.config import FEDERATED, ClusterOptions, DatasetSpec, RunConfig
from semproxy.functions.scoring import ProxyModel
from semproxy.operators.cascade import score_rows
from semproxy.operators.labeling import (
    FunctionLabeler,
    GoldLabeler,
    append_labels,
    exclude_labeled,
    fetch_by_ids,
    label_lookup,
)
from semproxy.operators.propagation import ClusterPropagation
from semproxy.operators.sampling import ClusterSampler, RandomSampler
from semproxy.operators.training import LogisticTrainer
from semproxy.plans.presets import STRATEGIES
from semproxy.plans.runner import run_proxy_training
from semproxy.plans.semantic_filter import apply_filter, semantic_filter

TRAINER = LogisticTrainer(l2=1.0, max_iter=20)


def counting_labeler(spark):
    calls = spark.sparkContext.accumulator(0)

    def label(row):
        calls.add(1)
        assert row.text.startswith("text")
        return int(row.embedding[0] > 0)

    return FunctionLabeler(label), calls


@pytest.mark.parametrize("rounds,budget,fraction", [(1, 40, 0.2), (3, 30, 0.5)])
def test_random_runs(spark, blobs, rounds, budget, fraction):
    labeler, calls = counting_labeler(spark)
    config = RunConfig(
        rounds=rounds, label_budget=budget, initial_label_fraction=fraction, check_table=True
    )
    result = run_proxy_training(blobs, config, RandomSampler(), labeler, trainer=TRAINER)
    rows = result.ledger.collect()
    assert calls.value == budget == len({r["id"] for r in rows}) == len(rows)
    assert np.isfinite(result.model.weights).all()
    report = result.round_report.orderBy("round").collect()
    assert [r["acquired"] for r in report] == [r["requested"] for r in report]
    assert len(report) == rounds == len(result.models)
    assert result.model.weights[0] > abs(result.model.weights[1])


def test_propagation_buys_no_labels(spark, blobs):
    labeler, calls = counting_labeler(spark)
    config = RunConfig(rounds=2, label_budget=16, initial_label_fraction=0.5)
    sampler = ClusterSampler(ClusterOptions(16, 5))
    result = run_proxy_training(blobs, config, sampler, labeler, ClusterPropagation(), TRAINER)
    assert calls.value == result.ledger.count() <= 16


def test_same_seed_same_run(spark, blobs):
    config = RunConfig(rounds=2, label_budget=20, initial_label_fraction=0.5)
    gold = GoldLabeler(blobs.select("id", "label"))
    first, second = (
        run_proxy_training(table, config, RandomSampler(), gold, trainer=TRAINER)
        for table in (blobs, blobs.repartition(5))
    )
    assert first.model == second.model


@pytest.mark.parametrize("name", ["lc1", "lc2rec", "lc3", "lc4", "lc1rec"])
def test_sharded_strategies(blobs, name):
    strategy = STRATEGIES[name]
    config = RunConfig(
        rounds=2 if strategy.recursive else 1,
        label_budget=18,
        initial_label_fraction=0.5,
        shard_col="shard",
        shards=(0, 1, 2),
        placement=strategy.placement,
    )
    result = run_proxy_training(
        blobs,
        config,
        strategy.sampler(ClusterOptions(6, 3)),
        GoldLabeler(blobs.select("id", "label")),
        strategy.builder(),
        TRAINER,
    )
    ledger = result.ledger.collect()
    assert len({r["id"] for r in ledger}) == len(ledger) == 18
    per_shard = {s: sum(r["shard"] == s for r in ledger) for s in range(3)}
    assert set(per_shard.values()) == {6}
    assert np.isfinite(result.model.weights).all()
    assert (strategy.placement == FEDERATED) == (name in ("lc3", "lc4"))


def test_shards_outside_the_list_stay_out(blobs):
    config = RunConfig(label_budget=10, shard_col="shard", shards=(0, 2))
    result = run_proxy_training(
        blobs, config, RandomSampler(), GoldLabeler(blobs.select("id", "label")), trainer=TRAINER
    )
    assert {r["shard"] for r in result.ledger.collect()} == {0, 2}


def test_budget_beyond_the_rows(blobs):
    few = blobs.limit(12)
    gold = GoldLabeler(blobs.select("id", "label"))
    config = RunConfig(rounds=4, label_budget=50, initial_label_fraction=0.5)
    result = run_proxy_training(few, config, RandomSampler(), gold, trainer=TRAINER)
    report = result.round_report.orderBy("round").collect()
    assert [(r["requested"], r["acquired"]) for r in report] == [(25, 12), (9, 0)]
    rolled = RunConfig(rounds=2, label_budget=50, initial_label_fraction=0.5, roll_over=True)
    report = run_proxy_training(few, rolled, RandomSampler(), gold, trainer=TRAINER).round_report
    assert report.where("round = 1").first()["requested"] == 38


def test_budget_below_the_shard_count(blobs):
    """A shard without a quota adds nothing and loses nothing."""
    config = RunConfig(
        rounds=2,
        label_budget=5,
        initial_label_fraction=0.5,
        shard_col="shard",
        shards=(0, 1, 2),
    )
    gold = GoldLabeler(blobs.select("id", "label"))
    result = run_proxy_training(blobs, config, RandomSampler(), gold, trainer=TRAINER)
    rows = [(r["round"], r["shard"]) for r in result.ledger.collect()]
    assert sorted(rows) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]


def test_early_errors(spark, blobs):
    gold = GoldLabeler(blobs.select("id", "label"))
    with pytest.raises(ValueError, match="clusters"):
        run_proxy_training(blobs, RunConfig(), RandomSampler(), gold, ClusterPropagation())
    with pytest.raises(RuntimeError):
        run_proxy_training(blobs.limit(0), RunConfig(), RandomSampler(), gold)
    with pytest.raises(ValueError):
        FunctionLabeler(None)
    missing = GoldLabeler(blobs.select("id", "label").where("id <> 'r7'"))
    with pytest.raises(ValueError, match="missing"):
        run_proxy_training(blobs, RunConfig(label_budget=300), RandomSampler(), missing)
    twice = blobs.unionByName(blobs.where("id = 'r3'"))
    with pytest.raises(ValueError):
        run_proxy_training(twice, RunConfig(label_budget=301), RandomSampler(), gold)
    with pytest.raises(ValueError, match="duplicate"):
        run_proxy_training(twice, RunConfig(check_table=True), RandomSampler(), gold)


def test_configured_column_names(blobs):
    renamed = blobs.select(
        F.col("id").alias("key"), F.col("text").alias("review"), F.col("embedding").alias("vec")
    )
    config = RunConfig(label_budget=20, dataset=DatasetSpec("key", "review", "vec"))
    gold = GoldLabeler(blobs.select("id", "label"))
    result = run_proxy_training(renamed, config, RandomSampler(), gold, trainer=TRAINER)
    assert result.ledger.count() == 20


def test_label_tables(spark, blobs):
    pool = blobs.select("id", "label")
    first = append_labels(None, pool.where("id in ('r1', 'r2')"))
    second = append_labels(first, pool.where("id = 'r3'"))
    assert second.count() == 3
    with pytest.raises(ValueError, match="already"):
        append_labels(second, pool.where("id = 'r1'"))
    assert exclude_labeled(pool, second).count() == 297
    assert fetch_by_ids(blobs, second.select("id")).columns == blobs.columns
    assert label_lookup(blobs.select("id"), pool).count() == 300
    with pytest.raises(Exception, match="no gold label"):
        label_lookup(blobs.select("id"), second).collect()


def test_semantic_filter(spark, blobs):
    labeler, calls = counting_labeler(spark)
    config = RunConfig(label_budget=60)
    kept = semantic_filter(blobs, labeler, config, (0.3, 0.7), trainer=TRAINER)
    used = calls.value
    truth = {r["id"] for r in blobs.where("label = 1").collect()}
    found = {r["id"] for r in kept.collect()}
    assert len(found & truth) / len(found | truth) > 0.95
    kept.count()
    assert calls.value == used


class Answers:
    """A labeler that changes the gold answers before it gives them."""

    def __init__(self, gold, change):
        self.gold, self.change, self.asked = gold, change, []

    def label(self, rows):
        self.asked.append(rows)
        return self.change(GoldLabeler(self.gold).label(rows))


@pytest.mark.parametrize(
    "change",
    [
        lambda df: df.where("id <> 'r7'"),
        lambda df: df.unionByName(df.limit(1)),
        lambda df: df.withColumn("id", F.concat(F.lit("x"), "id")),
        lambda df: df.withColumn("label", F.when(F.col("id") != "r7", F.col("label"))),
    ],
    ids=["missing", "repeated", "extra", "null"],
)
def test_filter_fails_on_incomplete_answers(blobs, change):
    rows = blobs.select("id", "text", "embedding")
    gold = blobs.select("id", "label")
    model = ProxyModel((0.5, 0.0), 0.0)
    with pytest.raises(ValueError, match="every selected id once"):
        apply_filter(rows, model, Answers(gold, change), 0.01, 0.99)


def test_filter_scores_once_and_reuses_bought_labels(blobs):
    rows = blobs.select("id", "text", "embedding")
    gold = blobs.select("id", "label")
    model = ProxyModel((2.0, 0.0), 0.0)
    known = gold.where("id < 'r2'")
    labeler = Answers(gold, lambda df: df)
    kept = apply_filter(rows, model, labeler, 0.2, 0.8, known)
    asked = {r["id"] for r in labeler.asked[0].collect()}
    assert asked and not asked & {r["id"] for r in known.collect()}
    scored = score_rows(rows, model).join(gold, "id")
    expected = scored.where("score >= 0.8 or (score > 0.2 and label = 1)")
    assert sorted(r["id"] for r in kept.collect()) == sorted(r["id"] for r in expected.collect())
    # The result reads written rows: nothing scores again.
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "zip_with" not in plan
