"""Grids of training runs, evaluated together, and their report."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semproxy.config import ClusterOptions, RunConfig
from semproxy.functions.scoring import LABELER_RATES, ProxyModel, batch_probabilities
from semproxy.operators.checks import require_valid_candidates
from semproxy.operators.labeling import GoldLabeler, label_lookup
from semproxy.operators.metrics import BANDS, Groups, ranked_by_confidence
from semproxy.operators.propagation import ClusterPropagation, DirectLabels
from semproxy.operators.sampling import ClusterSampler, RandomSampler
from semproxy.operators.training import LogisticTrainer
from semproxy.plans.runner import Rounds, TrainingRequest, TrainingResult, training_rounds
from semproxy.session import cut_lineage, drop_written, written

# Models scored and evaluated in one pass over the rows.
MODEL_BATCH = 16

# The report's columns in order. Timers of a single process's inner steps have no
# Spark counterpart and stay empty.
REPORT_COLUMNS = (
    "dataset", "sampler", "training_data_mode", "label_budget", "rounds",
    "initial_label_fraction", "uncertainty_center_1", "uncertainty_center_2", "seed", "rows",
    "embedding_dimensions", "data_setup_ms", "initial_sampling_ms", "initial_fetching_ms",
    "initial_labeling_ms", "initial_training_ms", "recursive_sampling_ms",
    "recursive_fetching_ms", "recursive_labeling_ms", "recursive_training_ms",
    "phase_a_total_ms", "phase_a_labels", "proxy_scoring_ms", "proxy_accuracy", "aurac",
    "initial_selection_query_ms", "initial_selection_materialization_ms",
    "initial_matrix_copy_ms", "initial_kmeans_ms", "initial_representative_selection_ms",
    "initial_selected_fetch_query_ms", "initial_selected_fetch_materialization_ms",
    "recursive_unlabeled_query_ms", "recursive_unlabeled_materialization_ms",
    "recursive_scoring_ms", "recursive_sort_and_copy_ms", "band_02_escalations",
    "band_02_final_accuracy", "band_02_total_calls", "band_01_escalations",
    "band_01_final_accuracy", "band_01_total_calls", "band_02_hosted_75rps_seconds",
    "band_02_server_250rps_seconds", "band_02_inprocess_1800rps_seconds",
)


@dataclass(frozen=True)
class SweepRun:
    """One grid point; cluster runs use as many clusters as labels."""

    sampler: str
    training_data_mode: str
    label_budget: int
    rounds: int
    initial_label_fraction: float = 1.0
    uncertainty_center_1: float = 0.5
    uncertainty_center_2: float = 0.5
    seed: int = 42

    @property
    def run_id(self) -> str:
        return "/".join(str(value) for value in asdict(self).values())


def sweep_grid(
    random_budgets: Iterable[int] = (32, 64, 128, 512, 1024),
    cluster_budgets: Iterable[int] = (32, 64, 128, 512, 1024),
    rounds: Iterable[int] = (1, 3, 5),
    fractions: Iterable[float] = (0.2,),
    centers: Iterable[tuple[float, float]] = ((0.5, 0.5),),
    seeds: Iterable[int] = (42, 43, 44),
) -> list[SweepRun]:
    """Every combination; one-shot runs do not vary fraction and centres, which they ignore."""
    modes = [("random", "direct", tuple(random_budgets))]
    modes += [
        ("cluster", mode, tuple(cluster_budgets)) for mode in ("direct", "cluster_propagation")
    ]
    return [
        SweepRun(sampler, mode, budget, count, fraction, *pair, seed)
        for sampler, mode, budgets in modes
        for budget in budgets
        for count in rounds
        for fraction in ((1.0,) if count == 1 else fractions)
        for pair in (((0.5, 0.5),) if count == 1 else centers)
        for seed in seeds
    ]


# The preset grids.
PRESETS = {
    "full": {},
    "sample": {"random_budgets": (64,), "cluster_budgets": (64,), "seeds": (42,)},
    "loader-benchmark": {"random_budgets": (), "cluster_budgets": (64,), "seeds": (42,)},
    "uncertainty-centers": {
        "random_budgets": (64, 128, 256),
        "cluster_budgets": (64, 128, 256),
        "rounds": (3, 5),
        "centers": ((0.5, 0.5), (0.1, 0.9), (0.2, 0.8)),
    },
}


def score_models(
    rows: DataFrame, models: dict[str, ProxyModel], gold: DataFrame | None = None
) -> DataFrame:
    """``(run_id, id, label, score)`` for every model, from one scan of the embeddings.

    Labels come with the rows or from ``gold``, which then meets the scores, not the embeddings.
    """
    names = F.array(*[F.lit(run_id) for run_id in models])
    scores = batch_probabilities(F.col("embedding"), list(models.values()))
    pairs = F.zip_with(
        names, scores, lambda run_id, score: F.struct(run_id.alias("run_id"), score.alias("score"))
    )
    if gold is None:
        scored = rows.select("id", "label", pairs.alias("_scores"))
    else:
        scored = label_lookup(rows.select("id", pairs.alias("_scores")), gold)
    return scored.select("id", "label", F.inline("_scores")).select(
        "run_id", "id", "label", "score"
    )


def evaluate_models(
    rows: DataFrame, models: dict[str, ProxyModel], gold: DataFrame | None = None
) -> DataFrame:
    """:func:`evaluate_proxy` of every model, :data:`MODEL_BATCH` models a pass, so that the rows
    written and ordered at once are bounded by the batch; each batch's results are written."""
    names = list(models)
    parts = []
    for start in range(0, len(names), MODEL_BATCH):
        batch = {name: models[name] for name in names[start : start + MODEL_BATCH]}
        scores = score_models(rows, batch, gold)
        parts.append(cut_lineage(evaluate_proxy(scores, ["run_id"], len(batch))))
    return reduce(DataFrame.unionByName, parts)


def evaluate_proxy(
    scores: DataFrame, groups: Groups = (), max_groups: int | None = None
) -> DataFrame:
    """Accuracy, AURAC and both cascade bands per group, from one ordered pass."""
    ranked = ranked_by_confidence(scores, groups, max_groups, ("label", "score"))
    aggregates = [
        F.count("*").alias("n_rows"),
        F.avg("correct").alias("proxy_accuracy"),
        F.avg(F.col("run_correct") / F.col("run_row")).alias("aurac"),
    ]
    for reject, accept in BANDS:
        name = f"band_{round(reject * 10):02d}"
        rejected = F.col("score") <= F.lit(reject)
        accepted = ~rejected & (F.col("score") >= F.lit(accept))
        wrong = (rejected & (F.col("label") != 0)) | (accepted & (F.col("label") != 1))
        aggregates += [
            F.count(F.when(~rejected & ~accepted, 1)).alias(f"{name}_escalations"),
            F.avg(F.when(wrong, 0).otherwise(1)).alias(f"{name}_final_accuracy"),
        ]
    return ranked.groupBy(*groups).agg(*aggregates)


def run_totals(round_report: DataFrame) -> DataFrame:
    """Labels and seconds per run, round 0 apart from the later rounds."""
    first = F.col("round") == 0
    sums = [F.sum("acquired").alias("phase_a_labels")]
    for name in ("sampling_s", "fetching_s", "labeling_s", "training_s"):
        sums.append(F.sum(F.when(first, F.col(name)).otherwise(0.0)).alias(f"initial_{name}"))
        sums.append(F.sum(F.when(first, 0.0).otherwise(F.col(name))).alias(f"recursive_{name}"))
    return round_report.groupBy("run_id").agg(*sums)


def train_together(
    runs: dict[str, Rounds], trainer: LogisticTrainer, parallelism: int, spark: SparkSession
) -> dict[str, TrainingResult]:
    """Advance all runs in step: their selections and labels ``parallelism`` at a time, then one
    grouped fit of the training rows of all of them, so that the jobs of fits follow the rounds and
    not the runs. A trainer without ``fit_groups`` fits one request at a time."""
    results: dict[str, TrainingResult] = {}
    models: dict[str, ProxyModel | None] = dict.fromkeys(runs)

    def advance(name: str) -> TrainingRequest | TrainingResult:
        try:
            return next(runs[name]) if models[name] is None else runs[name].send(models[name])
        except StopIteration as end:
            return end.value

    with ThreadPool(max(1, min(parallelism, len(runs)))) as pool:
        while models:
            names = list(models)
            found = dict(zip(names, pool.map(inheritable_thread_target(spark)(advance), names)))
            results |= {name: step for name, step in found.items() if isinstance(step, TrainingResult)}
            requests = {name: step for name, step in found.items() if name not in results}
            models = fit_together(requests, trainer) if requests else {}
    return results


def fit_together(requests: dict[str, TrainingRequest], trainer: Any) -> dict[str, ProxyModel]:
    """The models of all requests, by one optimiser over their rows."""
    if not hasattr(trainer, "fit_groups"):
        return {name: trainer.fit(r.examples, r.counts) for name, r in requests.items()}
    keyed = [
        request.examples.select(F.lit(name).alias("key"), "id", "embedding", "label")
        for name, request in requests.items()
    ]
    rows = written(reduce(DataFrame.unionByName, keyed), "requests")
    found = {name: model for name, (model, _) in trainer.fit_groups(rows).items()}
    for frame in [rows, *(request.examples for request in requests.values() if request.owned)]:
        drop_written(frame)
    return found


def run_sweep(
    candidates: DataFrame,
    gold: DataFrame,
    grid: list[SweepRun],
    dataset: str = "",
    max_iterations: int = 10,
    trainer: LogisticTrainer = LogisticTrainer(),
    parallelism: int = 4,
) -> DataFrame:
    """Train the runs of the grid round by round, the models of a round together, then score and
    evaluate all models in batches."""
    spark = candidates.sparkSession
    labeler = GoldLabeler(gold)
    started = time.perf_counter()
    require_valid_candidates(candidates, unique_ids=False)
    setup_ms = (time.perf_counter() - started) * 1000

    def settings_of(run: SweepRun) -> RunConfig:
        return RunConfig(
            rounds=run.rounds,
            label_budget=run.label_budget,
            initial_label_fraction=run.initial_label_fraction,
            uncertainty_center_1=run.uncertainty_center_1,
            uncertainty_center_2=run.uncertainty_center_2,
            seed=run.seed,
        )

    def rounds_of(run: SweepRun) -> Rounds:
        sampler = (
            ClusterSampler(ClusterOptions(run.label_budget, max_iterations))
            if run.sampler == "cluster"
            else RandomSampler()
        )
        builder = DirectLabels() if run.training_data_mode == "direct" else ClusterPropagation()
        return training_rounds(candidates, settings_of(run), sampler, labeler, builder, run.run_id)

    results = train_together({run.run_id: rounds_of(run) for run in grid}, trainer, parallelism, spark)
    results = [results[run.run_id] for run in grid]
    models = {run.run_id: result.model for run, result in zip(grid, results)}
    reports = reduce(DataFrame.unionByName, [result.round_report for result in results])
    started = time.perf_counter()
    evaluated = evaluate_models(candidates, models, gold)  # a row per run
    scoring_ms = (time.perf_counter() - started) * 1000
    width = len(next(iter(models.values())).weights)
    settings = spark.createDataFrame(
        [(run.run_id, dataset, *asdict(run).values()) for run in grid],
        "run_id string, dataset string, sampler string, training_data_mode string, "
        "label_budget long, rounds long, initial_label_fraction double, "
        "uncertainty_center_1 double, uncertainty_center_2 double, seed long",
    )
    ms = {"sampling_s": "sampling_ms", "fetching_s": "fetching_ms", "labeling_s": "labeling_ms", "training_s": "training_ms"}
    totals = run_totals(reports)
    phases = [
        (F.col(f"{part}_{seconds}") * 1000).alias(f"{part}_{name}")
        for part in ("initial", "recursive")
        for seconds, name in ms.items()
    ]
    total = sum((F.col(f"{p}_{s}") for p in ("initial", "recursive") for s in ms), F.lit(0.0))
    totals = totals.select(
        "run_id", "phase_a_labels", *phases, (total * 1000).alias("phase_a_total_ms")
    )
    wide = (
        settings.join(totals, "run_id")
        .join(evaluated.withColumnRenamed("n_rows", "rows"), "run_id")
        .withColumn("embedding_dimensions", F.lit(width))
        .withColumn("data_setup_ms", F.lit(setup_ms))
        .withColumn("proxy_scoring_ms", F.lit(scoring_ms))
    )
    for name in ("band_02", "band_01"):
        calls = F.col("phase_a_labels") + F.col(f"{name}_escalations")
        wide = wide.withColumn(f"{name}_total_calls", calls)
    for name, rate in LABELER_RATES.items():
        seconds = F.col("band_02_total_calls") / F.lit(float(rate))
        wide = wide.withColumn(f"band_02_{name}_{rate}rps_seconds", seconds)
    known = set(wide.columns)
    return wide.select(
        *[
            F.col(name) if name in known else F.lit(None).cast("double").alias(name)
            for name in REPORT_COLUMNS
        ]
    )


def write_sweep_report(report: DataFrame, path: str) -> DataFrame:
    """Write the report as CSV with a header; returns the written rows."""
    report.select(*REPORT_COLUMNS).write.mode("errorifexists").option("header", True).csv(path)
    return report.sparkSession.read.option("header", True).schema(report.schema).csv(path)
