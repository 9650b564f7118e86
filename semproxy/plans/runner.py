"""The training loop: sample, label, build, train, then select, label, build, train again."""

from __future__ import annotations

import time
from collections.abc import Generator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semproxy.config import FEDERATED, RunConfig, initial_budget, recursive_budget
from semproxy.functions.scoring import ProxyModel
from semproxy.operators.checks import (
    example_counts,
    label_counts,
    merged_counts,
    require_counted_labels,
    require_valid_candidates,
    require_valid_labels,
)
from semproxy.operators.labeling import Labeler, exclude_labeled
from semproxy.operators.propagation import DirectLabels, TrainingDataBuilder
from semproxy.operators.sampling import Sampler, select_uncertain
from semproxy.operators.training import LogisticTrainer, federated_train
from semproxy.session import bucketed, cut_lineage, drop_bucketed, drop_written, observed, written
from semproxy.sources.candidates import fetch_candidates, load_embeddings_only, selected_ids

ROUND_SCHEMA = (
    "run_id string, round int, requested long, acquired long, "
    "sampling_s double, fetching_s double, labeling_s double, training_s double"
)


@dataclass(frozen=True)
class TrainingResult:
    """``ledger`` holds one row per bought label; ``models`` the model after every round."""

    model: ProxyModel
    models: tuple[ProxyModel, ...]
    ledger: DataFrame
    round_report: DataFrame


@dataclass(frozen=True)
class TrainingRequest:
    """Rows a round wants a model of. ``counts`` are what the writes of the rows counted on the way,
    None where nobody has counted; ``owned`` rows are dropped once they are fitted."""

    examples: DataFrame
    federated: bool
    counts: dict | None = None
    owned: bool = False


Rounds = Generator[TrainingRequest, ProxyModel, "TrainingResult"]


def run_proxy_training(
    table: DataFrame,
    config: RunConfig,
    sampler: Sampler,
    labeler: Labeler,
    builder: TrainingDataBuilder = DirectLabels(),
    trainer: LogisticTrainer = LogisticTrainer(),
    run_id: str = "",
) -> TrainingResult:
    """Spend ``config.label_budget`` labels over ``config.rounds`` rounds and train the proxy.

    Every label is bought once: the selected ids and then the labeled rows of a round are
    written, or with the driver, before anything else reads them. Training on direct labels never
    goes back to the table, because the ledger keeps the embeddings of its rows.
    """
    rounds = training_rounds(table, config, sampler, labeler, builder, run_id)
    request = next(rounds)
    while True:
        try:
            request = rounds.send(fit_request(request, config, trainer))
        except StopIteration as end:
            return end.value


def fit_request(request: TrainingRequest, config: RunConfig, trainer: Any) -> ProxyModel:
    if request.federated:
        model = federated_train(request.examples, config.shard_col, config.shards, trainer)
    else:
        model = trainer.fit(request.examples, request.counts)
    if request.owned:
        drop_written(request.examples)
    return model


def training_rounds(
    table: DataFrame,
    config: RunConfig,
    sampler: Sampler,
    labeler: Labeler,
    builder: TrainingDataBuilder = DirectLabels(),
    run_id: str = "",
) -> Rounds:
    """The rounds of a run as a generator: it yields the training rows of each round and is sent
    their model, so that the models of several runs can be fitted together.

    What a round needs to know of its ids, answers and covered rows is counted while these are
    written, not by jobs of their own. Runs of several rounds keep the pool as a table bucketed by
    id, so later rounds neither decode the source again nor shuffle the pool to exclude the ledger.
    """
    if builder.needs_clusters and not sampler.creates_clusters:
        raise ValueError("this builder needs a sampler that creates clusters")
    spark = table.sparkSession
    shard_col, shards = config.shard_col, config.shards
    keep = () if shard_col is None else (shard_col,)
    if shard_col is not None:
        table = table.where(F.col(shard_col).isin(list(shards)))
    pool = load_embeddings_only(table, config.dataset, keep)
    if config.check_table:
        require_valid_candidates(pool.where(F.col("id").isNotNull()))
    kept = config.rounds > 1
    if kept:
        pool = bucketed(pool, "id")

    first = initial_budget(config)
    remaining = config.label_budget - first
    reports, models = [], []
    ledger, partition, model, counts = None, None, None, None
    for number in range(config.rounds):
        if number == 0:
            budget = first
        elif remaining > 0:
            budget = recursive_budget(remaining, config.rounds - number)
        else:
            break
        started = time.perf_counter()
        if number == 0:
            selection = sampler.select_initial(pool, budget, config.seed, shard_col, shards)
            ids, partition = selection.ids, selection.partition
        else:
            unlabeled = exclude_labeled(pool, ledger, config.label_budget)
            ids = select_uncertain(
                unlabeled,
                model,
                budget,
                config.uncertainty_center_1,
                config.uncertainty_center_2,
                shard_col,
                shards,
            )
        # Few ids are kept by the driver, more are written.
        values = selected_ids(table, ids, budget, config.dataset)
        if values is None:
            ids = cut_lineage(ids.select("id"))
        sampled = time.perf_counter()

        batch, acquired, fetched = None, 0, sampled
        if values != []:
            selected = fetch_candidates(table, ids, budget, config.dataset, keep, values)
            if values is None:
                selected = written(selected, "selected")
            fetched = time.perf_counter()
            labeled = labeler.label(selected).select(
                "id", "embedding", *keep, F.col("label").cast("int"), F.lit(number).alias("round")
            )
            watched, answers = observed(labeled, *label_counts(), *example_counts())
            batch = written(watched, "labels")
            if values is None:
                acquired = require_valid_labels(batch, ids, budget)
                drop_written(selected)
            else:
                acquired = require_counted_labels(answers.get, values, batch, budget)
        labeled_at = time.perf_counter()
        if acquired == 0 and number == 0:
            raise RuntimeError("initial sampling produced no labeled examples")
        if acquired:
            ledger = batch if ledger is None else ledger.unionByName(batch)
            counts = merged_counts(counts, answers.get)
            training = builder.build(ledger, pool, partition)
            if config.placement == FEDERATED:
                model = yield TrainingRequest(training, True)
            elif isinstance(builder, DirectLabels):
                model = yield TrainingRequest(training, False, counts)
            else:
                # One scan of the pool per round: the check and the fit read the written rows.
                watched, covering = observed(training.select("id", "embedding", "label"), *example_counts())
                covered = written(watched, "covered")
                model = yield TrainingRequest(covered, False, covering.get, owned=True)
            models.append(model)
        trained = time.perf_counter()
        reports.append(
            (
                run_id,
                number,
                budget,
                acquired,
                sampled - started,
                fetched - sampled,
                labeled_at - fetched,
                trained - labeled_at,
            )
        )
        if acquired == 0:
            break
        if number > 0:
            remaining -= acquired
        elif config.roll_over:
            remaining = config.label_budget - acquired
    if kept:
        drop_bucketed(pool)
    return TrainingResult(
        model, tuple(models), ledger, spark.createDataFrame(reports, ROUND_SCHEMA)
    )
