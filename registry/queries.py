"""One query per operator, over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.tables import (
    ORDER_MODEL,
    SEED,
    VECTOR_MODEL,
    candidates,
    is_finite,
    order_scores,
    order_tied_scores,
    orders,
    table,
    vector_scores,
    vectors,
)
from semproxy.config import (
    ClusterOptions,
    DatasetSpec,
    RunConfig,
    config_violations,
    round_budgets,
    shard_budget,
    shard_quotas,
)
from semproxy.functions import scoring
from semproxy.operators import cascade, checks, metrics, propagation
from semproxy.operators.clustering import (
    AssignmentTable,
    CentroidPartition,
    cluster_representatives,
    cluster_sums,
    kmeans_partition,
    sharded_kmeans,
)
from semproxy.operators.labeling import (
    FunctionLabeler,
    GoldLabeler,
    append_labels,
    exclude_labeled,
    fetch_by_ids,
    label_lookup,
)
from semproxy.operators.model_table import append_versions, score_as_of
from semproxy.operators.sampling import (
    ClusterSampler,
    RandomSampler,
    sample_random,
    select_uncertain,
    subset_representatives,
)
from semproxy.operators.training import LogisticTrainer, average_models, federated_train
from semproxy.plans.presets import STRATEGIES
from semproxy.plans.runner import run_proxy_training
from semproxy.plans.semantic_filter import apply_filter, semantic_filter
from semproxy.plans.sweep import (
    SweepRun,
    evaluate_models,
    evaluate_proxy,
    run_sweep,
    run_totals,
    sweep_grid,
    write_sweep_report,
)
from semproxy.session import scratch_path
from semproxy.sources.artifacts import read_model, score_dump_join, write_model
from semproxy.sources.candidates import (
    attach_embeddings,
    load_candidates,
    load_embeddings_only,
    read_labeled_csv,
    write_examples,
)
from semproxy.streaming.scoring import score_new_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SPEC = DatasetSpec("vec_id", "text", "embedding")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def r9(column, name: str):
    return F.round(column, 9).alias(name)


def total(embedding="embedding"):
    summed = F.aggregate(embedding, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return r9(summed, "total")


def first_sample(spark: SparkSession, sf_dir: str, rows: int) -> DataFrame:
    return sample_random(vectors(spark, sf_dir), rows, SEED)


def direct_labels(spark: SparkSession, sf_dir: str, rows: int) -> DataFrame:
    pool = vectors(spark, sf_dir)
    return fetch_by_ids(pool, sample_random(pool, rows, SEED), rows)


def one_step_partition(spark: SparkSession, sf_dir: str) -> CentroidPartition:
    """Eight clusters after one mean step from the rows with the smallest seeded keys."""
    pool = vectors(spark, sf_dir).select("id", "embedding", F.lit(0).alias("shard"))
    centers = sharded_kmeans(pool, "shard", (0,), ClusterOptions(8, 1), SEED).centers
    return CentroidPartition(centers)


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_step_partition(spark, sf_dir).assign(vectors(spark, sf_dir))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", "label")


# Scans, sources, sinks


@query
def load_candidates_(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    source = table(spark, sf_dir, "embeddings").join(documents, "vec_id", "left")
    loaded = load_candidates(source, SPEC)
    return loaded.select(
        "id", F.md5("text").alias("text_md5"), F.size("embedding").alias("width"), total()
    )


@query
def load_embeddings_only_(spark, sf_dir):
    loaded = load_embeddings_only(table(spark, sf_dir, "embeddings"), SPEC)
    return loaded.select("id", F.size("embedding").alias("width"), total())


def _documents_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a labeled CSV in document order, read back."""
    quality = table(spark, sf_dir, "labels").select("doc_id", "quality")
    path = scratch_path(spark, "reviews-csv")
    sentiment = F.when(F.col("quality") == 1, "POSITIVE").otherwise("NEGATIVE")
    (
        table(spark, sf_dir, "documents")
        .join(quality, "doc_id", "left")
        .select("doc_id", F.col("text").alias("reviewText"), sentiment.alias("scoreSentiment"))
        .orderBy("doc_id")
        .write.option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return read_labeled_csv(spark, path)


@query
def read_labeled_csv_(spark, sf_dir):
    return _documents_csv(spark, sf_dir).select(
        "row_index", F.md5("text").alias("text_md5"), "label"
    )


@query
def positional_row_number(spark, sf_dir):
    rows = _documents_csv(spark, sf_dir)
    return rows.select("row_index", F.length("text").alias("chars"))


@query
def attach_embeddings_(spark, sf_dir):
    labeled = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_index"),
        F.col("o_orderpriority").alias("text"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
    )
    archive = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("position"), (F.col("vec_id") * 2).alias("row_index"), "embedding"
    )
    rows = archive.count() * 3 // 4
    attached = attach_embeddings(archive, labeled, maximum_rows=rows)
    return attached.select("id", "text", "label", total())


@query
def write_examples_(spark, sf_dir):
    examples = candidates(spark, sf_dir).select(
        "id", F.coalesce("text", F.lit("")).alias("text"), "embedding", "label"
    )
    written = write_examples(examples, scratch_path(spark, "examples"))
    return written.select("id", F.md5("text").alias("text_md5"), "label", total())


@query
def label_ledger(spark, sf_dir):
    pool = vectors(spark, sf_dir)
    ledger = None
    for number in range(2):
        rest = pool if ledger is None else exclude_labeled(pool, ledger, 20)
        batch = fetch_by_ids(pool, sample_random(rest, 20, SEED), 20)
        ledger = append_labels(
            ledger, batch.select("id", "label", "shard", F.lit(number).alias("round"))
        )
    return ledger


@query
def model_artifact(spark, sf_dir):
    model = LogisticTrainer(l2=0.1).fit(direct_labels(spark, sf_dir, 200))
    path = scratch_path(spark, "model")
    write_model(spark, model, path, "easy")
    read = read_model(spark, path, "easy")
    return read.to_df(spark, "easy").select(
        "run_id",
        F.size("weights").alias("width"),
        F.lit(is_finite((*read.weights, read.intercept))).alias("finite"),
        F.lit(read == model).alias("equal"),
    )


@query
def sweep_report(spark, sf_dir):
    report = _small_sweep(spark, sf_dir)
    written = write_sweep_report(report, scratch_path(spark, "sweep"))
    return written.select(
        "dataset",
        "sampler",
        "training_data_mode",
        "label_budget",
        "rounds",
        "seed",
        "rows",
        "embedding_dimensions",
        "phase_a_labels",
        *[(F.col(name) >= 0).alias(name) for name in written.columns if name in TIMED],
        (F.col("band_02_total_calls") == F.col("band_02_escalations") + F.col("phase_a_labels")).alias("calls"),
    )


# The phases of a run that the report times.
TIMED = [
    "data_setup_ms",
    "proxy_scoring_ms",
    "phase_a_total_ms",
    *[f"{part}_{phase}_ms" for part in ("initial", "recursive") for phase in ("sampling", "fetching", "labeling", "training")],
]


# Projections, filters, checks


@query
def filter_nonnull_id(spark, sf_dir):
    pool = vectors(spark, sf_dir).withColumn(
        "id", F.when(F.col("vec_id") % 7 != 0, F.col("id"))
    )
    return sample_random(pool, pool.count(), SEED)


@query
def pool_columns(spark, sf_dir):
    pool = load_embeddings_only(candidates(spark, sf_dir))
    return pool.select("id", total())


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = F.col("vec_id"), F.col("embedding")
    hole = F.transform(e, lambda x, i: F.when(i != 3, x))
    infinite = F.transform(e, lambda x, i: F.when(i != 5, x).otherwise(F.lit(float("inf"))))
    return vectors(spark, sf_dir).select(
        F.when(n % 50 == 0, None).when(n % 41 == 1, F.lit("1")).otherwise(F.col("id")).alias("id"),
        F.when(n % 60 == 1, None)
        .when(n % 45 == 2, hole)
        .when(n % 30 == 4, F.slice(e, 1, 10))
        .when(n % 70 == 5, F.slice(e, 1, 0))
        .when(n % 37 == 6, infinite)
        .otherwise(e)
        .cast("array<float>")
        .alias("embedding"),
        F.when(n % 33 == 7, 2).when(n % 34 == 8, None).otherwise(F.col("label")).alias("label"),
    )


@query
def validate_candidates(spark, sf_dir):
    return checks.candidate_violations(_damaged(spark, sf_dir))


@query
def validate_labeled_examples(spark, sf_dir):
    return checks.example_violations(_damaged(spark, sf_dir))


@query
def validate_selection(spark, sf_dir):
    selected = first_sample(spark, sf_dir, 30)
    again = first_sample(spark, sf_dir, 5)
    return checks.selection_violations(selected.unionByName(again), 25)


@query
def validate_labels(spark, sf_dir):
    selected = first_sample(spark, sf_dir, 30)
    labeled = direct_labels(spark, sf_dir, 40).select("id", "label")
    labeled = labeled.where(F.substring("id", -1, 1) != "3")
    twice = labeled.where(F.substring("id", -1, 1) == "1")
    return checks.label_violations(labeled.unionByName(twice), selected)


@query
def validate_run_config(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        config_violations(
            size % 4,
            size - 5,
            F.col("p_retailprice") / 1000,
            size / 45.0,
            F.when(size % 9 != 0, size / 60.0),
        ).alias("violations"),
    )


# Joins


@query
def fetch_by_ids_(spark, sf_dir):
    pool = vectors(spark, sf_dir)
    return fetch_by_ids(pool, sample_random(pool, 50, SEED), 50).select("id", "label", total())


@query
def exclude_labeled_(spark, sf_dir):
    pool = vectors(spark, sf_dir)
    return exclude_labeled(pool, sample_random(pool, 50, SEED), 50).select("id", "label")


@query
def fetch_by_ids_large(spark, sf_dir):
    """More ids than are broadcast, a tenth of the rows: their Bloom filter goes before the join."""
    pool = orders(spark, sf_dir)
    chosen = sample_random(pool, pool.count() // 10, SEED)
    return fetch_by_ids(pool, chosen).select("id", "label", total())


@query
def exclude_labeled_large(spark, sf_dir):
    pool = orders(spark, sf_dir)
    chosen = sample_random(pool, pool.count() // 10, SEED)
    return exclude_labeled(pool, chosen).select("id", "label")


@query
def assign_join(spark, sf_dir):
    clusters = assigned(spark, sf_dir).where(F.col("cluster") < 6)
    joined = propagation.assign_join(direct_labels(spark, sf_dir, 60), clusters)
    return joined.select("id", "cluster", "label")


def _few_votes(spark: SparkSession, sf_dir: str, partition: CentroidPartition) -> DataFrame:
    """Votes of three labels, so that clusters stay without one."""
    return propagation.cluster_votes(partition.assign(direct_labels(spark, sf_dir, 3)))


@query
def covered_clusters(spark, sf_dir):
    partition = one_step_partition(spark, sf_dir)
    rows = partition.assign(vectors(spark, sf_dir))
    votes = _few_votes(spark, sf_dir, partition)
    return propagation.covered_clusters(rows, votes, ("cluster",), 8).select(
        "id", "cluster", "positives", "negatives"
    )


@query
def label_lookup_(spark, sf_dir):
    answers = vectors(spark, sf_dir).select("id", F.col("hard").alias("label"))
    return label_lookup(vectors(spark, sf_dir).select("id", "shard"), answers)


# Aggregations


@query
def cluster_votes(spark, sf_dir):
    partition = one_step_partition(spark, sf_dir)
    labeled = direct_labels(spark, sf_dir, 60).withColumn(
        "label", F.when(F.col("vec_id") % 11 == 0, 2).otherwise(F.col("label"))
    )
    return propagation.cluster_votes(partition.assign(labeled))


@query
def majority_label(spark, sf_dir):
    partition = one_step_partition(spark, sf_dir)
    votes = propagation.cluster_votes(partition.assign(direct_labels(spark, sf_dir, 60)))
    label = propagation.majority_label(F.col("positives"), F.col("negatives"))
    return votes.select("cluster", label.alias("label"))


@query
def proxy_accuracy(spark, sf_dir):
    result = metrics.proxy_accuracy(vector_scores(spark, sf_dir), ["shard"])
    return result.select("shard", r9("proxy_accuracy", "proxy_accuracy"))


@query
def cascade_summary(spark, sf_dir):
    result = cascade.cascade_summary(vector_scores(spark, sf_dir))
    return result.select("reject", "accept", "escalations", r9("final_accuracy", "final_accuracy"))


@query
def run_totals_(spark, sf_dir):
    """Order lines stand for the rounds of a run."""
    report = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        (F.col("l_linenumber") - 1).alias("round"),
        F.col("l_quantity").cast("long").alias("acquired"),
        F.col("l_discount").alias("sampling_s"),
        F.col("l_quantity").alias("fetching_s"),
        F.col("l_tax").alias("labeling_s"),
        (F.col("l_extendedprice") / 1000).alias("training_s"),
    )
    totals = run_totals(report)
    timed = [name for name in totals.columns if name.endswith("_s")]
    return totals.select("run_id", "phase_a_labels", *[F.round(n, 6).alias(n) for n in timed])


# Ordered measures


@query
def risk_coverage_curve(spark, sf_dir):
    curve = metrics.risk_coverage_curve(vector_scores(spark, sf_dir))
    return curve.select("id", "kept", r9("coverage", "coverage"), r9("accuracy", "accuracy"))


@query
def risk_coverage_curve_tied(spark, sf_dir):
    curve = metrics.risk_coverage_curve(order_tied_scores(spark, sf_dir), ["shard"], 3)
    return curve.select(
        "shard", "id", "kept", r9("coverage", "coverage"), r9("accuracy", "accuracy")
    )


@query
def aurac(spark, sf_dir):
    return metrics.aurac(order_scores(spark, sf_dir)).select(r9("aurac", "aurac"))


@query
def cluster_representatives_(spark, sf_dir):
    return cluster_representatives(assigned(spark, sf_dir))


# Sorts, limits, top-k


@query
def sample_random_(spark, sf_dir):
    return sample_random(orders(spark, sf_dir), 200, SEED)


@query
def sample_random_large(spark, sf_dir):
    """A budget that grows with the table: a tenth of its rows."""
    pool = orders(spark, sf_dir)
    return sample_random(pool, pool.count() // 10, SEED)


@query
def subset_representatives_(spark, sf_dir):
    found = cluster_representatives(assigned(spark, sf_dir))
    return subset_representatives(found, 5, SEED)


@query
def select_uncertain_(spark, sf_dir):
    pool = vectors(spark, sf_dir)
    unlabeled = exclude_labeled(pool, sample_random(pool, 20, SEED), 20)
    return select_uncertain(unlabeled, VECTOR_MODEL, 25, 0.2, 0.8).select("id", r9("u", "u"))


@query
def select_uncertain_orders(spark, sf_dir):
    return select_uncertain(orders(spark, sf_dir), ORDER_MODEL, 100).select("id", r9("u", "u"))


@query
def select_uncertain_large(spark, sf_dir):
    """A tenth of the rows."""
    pool = orders(spark, sf_dir)
    return select_uncertain(pool, ORDER_MODEL, pool.count() // 10).select("id", r9("u", "u"))


@query
def shard_top_k(spark, sf_dir):
    chosen = select_uncertain(
        vectors(spark, sf_dir), VECTOR_MODEL, 22, 0.2, 0.8, "shard", (0, 1, 2, 3)
    )
    return chosen.select("id", "shard")


# Set operations


@query
def pool_batches(spark, sf_dir):
    """One batch per shard, put together."""
    pool = vectors(spark, sf_dir)
    batches = []
    for shard, quota in shard_quotas(30, (0, 1, 2, 3)).items():
        rows = pool.where(F.col("shard") == shard)
        batches.append(fetch_by_ids(rows, sample_random(rows, quota, SEED), quota))
    return reduce(DataFrame.unionByName, batches).select("id", "shard", "label")


@query
def accumulate_labels(spark, sf_dir):
    ledger = label_ledger(spark, sf_dir)
    return ledger.groupBy("round").agg(
        F.count("*").alias("labels"), F.sum("label").alias("positives")
    )


# Scalar functions


@query
def predict_probability(spark, sf_dir):
    return vector_scores(spark, sf_dir).select("id", r9("score", "score"))


@query
def predict_probability_orders(spark, sf_dir):
    return order_scores(spark, sf_dir).select("id", r9("score", "score"))


@query
def stable_sigmoid(spark, sf_dir):
    z = (F.col("o_totalprice") - 250000) / 250
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", r9(scoring.stable_sigmoid(z), "p")
    )


@query
def squared_distance(spark, sf_dir):
    rows = assigned(spark, sf_dir)
    centers = one_step_partition(spark, sf_dir).centroids(spark).drop("shard")
    own = rows.drop("distance").join(F.broadcast(centers), "cluster")  # eight centres
    distance = scoring.squared_distance(F.col("embedding"), F.col("center"))
    return own.select("id", r9(distance, "distance"))


@query
def seeded_hash(spark, sf_dir):
    return orders(spark, sf_dir).select("id", scoring.seeded_key(F.col("id"), SEED).alias("key"))


@query
def zone(spark, sf_dir):
    return cascade.route(vector_scores(spark, sf_dir), 0.2, 0.8).select("id", "zone")


@query
def streaming_scores(spark, sf_dir):
    """A stream over a folder that grows, stopped and started again between its two batches."""
    folder = scratch_path(spark, "stream")
    rows = vectors(spark, sf_dir).select("id", "embedding", "vec_id")
    for part in (0, 1):
        rows.where(F.col("vec_id") % 2 == part).drop("vec_id").write.mode("append").parquet(f"{folder}/in")
        found = score_new_files(
            spark, f"{folder}/in", rows.drop("vec_id").schema, f"{folder}/out", f"{folder}/checkpoint", VECTOR_MODEL
        )
    return found.select("id", "zone", r9("score", "score"))


@query
def projected_latency(spark, sf_dir):
    summary = cascade.cascade_summary(order_scores(spark, sf_dir), groups=["shard"])
    summary = summary.withColumn("labels", F.lit(200))
    return cascade.total_calls(summary).select(
        "shard",
        "reject",
        "total_calls",
        *[r9(f"{name}_seconds", f"{name}_seconds") for name in scoring.LABELER_RATES],
    )


# Models and pipelines


@query
def kmeans_partition_(spark, sf_dir):
    """A converged partition: every row has a cluster and every centre is its rows' mean."""
    pool = vectors(spark, sf_dir).select("id", "embedding", F.lit(0).alias("shard"))
    partition = kmeans_partition(pool, ClusterOptions(12, 100), SEED)
    sums = cluster_sums(pool, "shard", partition.centers)
    centers = partition.centroids(spark).select("cluster", "center")
    mean = F.transform("total", lambda x: x / F.col("n_rows"))
    gaps = sums.join(F.broadcast(centers), "cluster").select(  # twelve centres
        "n_rows", scoring.squared_distance(mean, F.col("center")).alias("gap")
    )
    return gaps.agg(
        F.sum("n_rows").alias("n_rows"),
        F.count("*").alias("clusters"),
        (F.max("gap") < 1e-6).alias("centred"),
    )


@query
def nearest_centroid(spark, sf_dir):
    return assigned(spark, sf_dir).select("id", "cluster", r9("distance", "distance"))


@query
def train_logistic(spark, sf_dir):
    """A fit on 200 labels: its gradient vanishes on them, and it separates all rows well."""
    labeled = direct_labels(spark, sf_dir, 200)
    model = LogisticTrainer(l2=0.1, max_iter=200, tol=1e-12).fit(labeled)
    accuracy = metrics.proxy_accuracy(cascade.score_rows(vectors(spark, sf_dir), model))
    learned = accuracy.select((F.col("proxy_accuracy") > 0.8).alias("learned"))
    return _flat(labeled, model, 0.1).join(F.broadcast(learned))  # one row


@query
def train_logistic_optimum(spark, sf_dir):
    """At the optimum of the penalised loss its gradient vanishes in every position."""
    rows = orders(spark, sf_dir)
    l2 = 1.0
    model = LogisticTrainer(l2=l2, max_iter=200, tol=1e-12).fit(rows)
    return _flat(rows, model, l2)


def _flat(rows: DataFrame, model: scoring.ProxyModel, l2: float) -> DataFrame:
    """Whether the gradient of the penalised loss over ``rows`` vanishes, by position."""
    scored = cascade.score_rows(rows, model)
    slope = F.col("score") - F.col("label")
    parts = [F.avg(slope * F.col("embedding")[i].cast("double")) for i in range(len(model.weights))]
    parts = [p + l2 * w / rows.count() for p, w in zip(parts, model.weights)]
    gradient = scored.agg(F.array(F.avg(slope), *parts).alias("g"))
    return gradient.select(F.posexplode("g").alias("position", "g")).select(
        "position", (F.abs("g") < 1e-4).alias("flat")
    )


@query
def direct_training_set(spark, sf_dir):
    labeled = direct_labels(spark, sf_dir, 60)
    built = propagation.DirectLabels().build(labeled, vectors(spark, sf_dir), None)
    return built.select("id", "label", total())


@query
def propagated_training_set(spark, sf_dir):
    partition = one_step_partition(spark, sf_dir)
    rows = partition.assign(vectors(spark, sf_dir))
    votes = _few_votes(spark, sf_dir, partition)
    return propagation.propagated_training_set(rows, votes, ("cluster",), 8).select(
        "id", "label", total()
    )


@query
def propagated_from_table(spark, sf_dir):
    """The same with the clusters given as an assignment table."""
    clusters = AssignmentTable(assigned(spark, sf_dir).select("id", "cluster"))
    pool = vectors(spark, sf_dir)
    built = propagation.ClusterPropagation().build(
        direct_labels(spark, sf_dir, 3), pool, clusters
    )
    return built.select("id", "label")


@query
def round_budget(spark, sf_dir):
    per_source = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("budget")
    )
    return round_budgets(per_source, "budget", 4, 0.3).select(
        "source", "budget", "round", "requested"
    )


@query
def shard_budget_(spark, sf_dir):
    totals = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        F.count("*").alias("total")
    )
    shards = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("shard"))
    quota = shard_budget(F.col("total"), F.col("shard"), 7).alias("quota")
    return shards.select("c_mktsegment", "shard", quota)


class MeanTrainer:
    """A user's own trainer that SQL can follow: from the mean of label 0 to that of label 1."""

    def for_shard(self):
        return self

    def fit(self, examples: DataFrame, counts: dict | None = None) -> scoring.ProxyModel:
        values = examples.select("label", F.posexplode("embedding").alias("position", "x"))
        x = F.col("x").cast("double")
        means = values.groupBy("position").agg(
            F.avg(F.when(F.col("label") == 1, x)).alias("one"),
            F.avg(F.when(F.col("label") == 0, x)).alias("zero"),
        )
        rows = means.orderBy("position").collect()
        return scoring.ProxyModel(tuple((r["one"] or 0.0) - (r["zero"] or 0.0) for r in rows), 0.0)


def model_rows(spark: SparkSession, model: scoring.ProxyModel) -> DataFrame:
    return model.to_df(spark).select(
        F.posexplode("weights").alias("position", "w"), F.col("intercept")
    ).select("position", r9("w", "weight"), "intercept")


def _run(spark, sf_dir, name, budget=48, rounds=3, clusters=12, builder=None, **settings):
    strategy = STRATEGIES[name]
    if strategy.sharded:
        settings = {"shard_col": "shard", "shards": (0, 1, 2, 3)} | settings
    config = RunConfig(
        rounds=rounds if strategy.recursive else 1,
        label_budget=budget,
        initial_label_fraction=0.5,
        placement=strategy.placement,
        seed=SEED,
        **settings,
    )
    pool = candidates(spark, sf_dir)
    if config.shard_col == "region":
        pool = pool.withColumn("region", F.concat(F.lit("s"), F.col("shard").cast("string")))
    return run_proxy_training(
        pool,
        config,
        strategy.sampler(ClusterOptions(clusters, 2)),
        GoldLabeler(gold(spark, sf_dir)),
        builder or strategy.builder(),
        MeanTrainer(),
        name,
    )


@query
def run_proxy_training_(spark, sf_dir):
    """Every label of three rounds; the later rows follow from the models in between."""
    return _run(spark, sf_dir, "recursive", 60).ledger.select("id", "label", "round")


@query
def run_sharded_text(spark, sf_dir):
    """Shards with names instead of numbers."""
    regions = {"shard_col": "region", "shards": ("s0", "s1", "s2", "s3")}
    ledger = _run(spark, sf_dir, "lc1", 24, clusters=6, **regions).ledger
    return ledger.select("id", "region", "label", "round")


@query
def random_sharded(spark, sf_dir):
    return _run(spark, sf_dir, "random_sharded", 26).ledger.select("id", "shard", "label")


@query
def kmeans_copies(spark, sf_dir):
    """Every vector in five copies: starts stay distinct, so as many representatives as asked for.

    Each comes with the rows of its cluster, and with how many clusters and rows there are and how
    many copies were parted from their vector."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("copy")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", copies)
    pool = rows.select(F.concat_ws("-", "copy", "vec_id").alias("id"), "embedding")
    selection = ClusterSampler(ClusterOptions(50, 5)).select_initial(pool, 50, SEED)
    assigned = selection.partition.assign(pool)
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("in_cluster"))
    totals = sizes.agg(
        F.count("*").alias("clusters"),
        F.sum("in_cluster").alias("n_rows"),
        F.sum(F.col("in_cluster") % 5).alias("parted"),
    )
    chosen = cluster_representatives(assigned).join(F.broadcast(selection.ids), "id", "left_semi")  # fifty
    found = chosen.join(F.broadcast(sizes), "cluster").crossJoin(F.broadcast(totals))  # fifty, one
    return found.select("id", "cluster", "in_cluster", "clusters", "n_rows", "parted")


@query
def run_sharded_central(spark, sf_dir):
    """Representatives of six clusters in each of four shards, labeled and pooled."""
    result = _run(spark, sf_dir, "lc1", 24, clusters=6)
    return result.ledger.select("id", "shard", "label", "round")


@query
def round_report(spark, sf_dir):
    report = _run(spark, sf_dir, "gc1rec", 40, 4, clusters=40).round_report
    return report.select(
        "run_id", "round", "requested", "acquired", (F.col("fetching_s") > 0).alias("fetched")
    )


@query
def model_broadcast(spark, sf_dir):
    """Every row by the last model its shard was sent at or before the row's round; a model is the
    mean vector of some rows, and not every shard is sent one in every round."""
    rows = vectors(spark, sf_dir)
    number = (F.floor(F.col("vec_id") / 4) % 5).cast("int")
    values = rows.where((F.col("shard") + number) % 3 != 0).select(
        "shard", number.alias("round"), F.posexplode("embedding").alias("pos", "x")
    )
    means = values.groupBy("shard", "round", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "m")))
    versions = means.groupBy("shard", "round").agg(F.transform(ordered, lambda item: item["m"]).alias("weights"))
    versions = versions.select(
        F.lit("run").alias("run_id"), F.col("shard").cast("string").alias("shard"), "round", "weights",
        (F.col("round") / 10).alias("intercept"),
    )
    path = scratch_path(spark, "versions")
    append_versions(versions.where("round < 2"), path)
    table_ = append_versions(versions.where("round >= 2"), path)
    asked = rows.withColumn("round", (F.col("vec_id") % 7 - 1).cast("int"))
    return score_as_of(asked, table_, "run").select("id", "shard", "round", "model_round", r9("score", "score"))


@query
def evaluate_proxy_(spark, sf_dir):
    return _rounded(evaluate_proxy(vector_scores(spark, sf_dir)))


@query
def evaluate_proxy_orders(spark, sf_dir):
    return _rounded(evaluate_proxy(order_scores(spark, sf_dir), ["shard"], 3))


def _rounded(evaluated: DataFrame) -> DataFrame:
    return evaluated.select(
        *[r9(name, name) if kind == "double" else name for name, kind in evaluated.dtypes]
    )


def _small_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = sweep_grid((16,), (16,), (1,), seeds=(42,))
    grid.append(SweepRun("random", "direct", 16, 2, 0.5))
    pool = candidates(spark, sf_dir).select("id", "text", "embedding")
    trainer = LogisticTrainer(l2=1.0, max_iter=20)
    return run_sweep(pool, gold(spark, sf_dir), grid, "vectors", 3, trainer)


@query
def run_sweep_(spark, sf_dir):
    """The scoring half: twenty models over all rows, in batches of one matrix product each."""
    models = {
        f"m{i}": scoring.ProxyModel(tuple(w * (1 - i / 10) for w in VECTOR_MODEL.weights), i / 8)
        for i in range(20)
    }
    return _rounded(evaluate_models(vectors(spark, sf_dir), models))


@query
def sampler(spark, sf_dir):
    pool = vectors(spark, sf_dir)
    return RandomSampler().select_initial(pool, 40, 7).ids


@query
def cluster_sampler(spark, sf_dir):
    chosen = ClusterSampler(ClusterOptions(6, 2)).select_initial(
        vectors(spark, sf_dir), 10, SEED, "shard", (0, 1, 2, 3)
    )
    return chosen.ids.select("id", "shard")


@query
def labeler(spark, sf_dir):
    """A batched Python labeler over text."""
    text = F.coalesce("text", F.lit("")).alias("text")
    texts = candidates(spark, sf_dir).select("id", text, "embedding")
    labeled = FunctionLabeler(lambda row: int(len(row.text) % 2 == 0)).label(texts)
    return labeled.select("id", "label")


@query
def labeler_log(spark, sf_dir):
    """Answers kept by id: the second run of the labeler only reads them."""
    documents = table(spark, sf_dir, "documents")
    rows = documents.select(F.col("doc_id").cast("string").alias("id"), "text")
    name = uuid.uuid4().hex
    FunctionLabeler(lambda row: row.text.count("e") % 2, 8, name).label(rows).write.format("noop").mode("overwrite").save()
    again = FunctionLabeler(lambda row: 1 / 0, 8, name).label(rows)
    return again.groupBy("label").agg(F.count("*").alias("n_rows"))


@query
def function_labeler(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    rows = documents.select(F.col("doc_id").cast("string").alias("id"), "text")
    labeled = FunctionLabeler(lambda row: row.text.count("e") % 2).label(rows)
    return labeled.groupBy("label").agg(F.count("*").alias("n_rows"))


@query
def training_data_builder(spark, sf_dir):
    """A user's own builder: all rows of the pool, labeled by one value of their vectors."""

    class SignLabels:
        needs_clusters = False

        def build(self, direct, pool, partition):
            label = F.when(F.col("embedding")[5] > 0, 1).otherwise(0).alias("label")
            return pool.select("id", "embedding", label)

    return model_rows(spark, _run(spark, sf_dir, "random", 24, builder=SignLabels()).model)


# Documented operators


@query
def semantic_filter_(spark, sf_dir):
    """With the fixed model: accepted rows, and escalated rows whose label is positive."""
    rows = candidates(spark, sf_dir).select("id", "text", "embedding")
    kept = apply_filter(rows, VECTOR_MODEL, GoldLabeler(gold(spark, sf_dir)), 0.2, 0.8)
    return kept.select("id", "zone", r9("score", "score"))


@query
def semantic_filter_trained(spark, sf_dir):
    """Trained on 100 labels; the rows between the bands go to the labeler."""
    rows = candidates(spark, sf_dir).select("id", "text", "embedding")
    config = RunConfig(label_budget=100, seed=SEED)
    labeler = GoldLabeler(gold(spark, sf_dir))
    kept = semantic_filter(rows, labeler, config, (0.48, 0.52), trainer=MeanTrainer())
    return kept.select("id", "zone", r9("score", "score"))


@query
def semantic_filter_text(spark, sf_dir):
    """A Python labeler reads the texts of the escalated rows."""
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = candidates(spark, sf_dir).select("id", text, "embedding")
    labeler = FunctionLabeler(lambda row: int(len(row.text) % 3 == 0))
    return apply_filter(rows, VECTOR_MODEL, labeler, 0.2, 0.8).select("id", "zone")


@query
def lc2_local_propagation(spark, sf_dir):
    """Training rows after three labels per shard are spread over that shard's clusters."""
    pool = vectors(spark, sf_dir)
    shards = (0, 1, 2, 3)
    chosen = ClusterSampler(ClusterOptions(6, 2)).select_initial(pool, 12, SEED, "shard", shards)
    direct = fetch_by_ids(pool, chosen.ids, 12)
    built = propagation.ClusterPropagation().build(direct, pool, chosen.partition)
    return built.select("id", "shard", "label")


@query
def federated_train_(spark, sf_dir):
    """The average over the shards of each shard's model."""
    pool = vectors(spark, sf_dir)
    return model_rows(spark, federated_train(pool, "shard", (0, 1, 2, 3), MeanTrainer()))


@query
def federated_logistic(spark, sf_dir):
    """Averaged logistic fits separate the learnable label well."""
    pool = vectors(spark, sf_dir)
    model = federated_train(pool, "shard", (0, 1, 2, 3), LogisticTrainer(l2=0.1, max_iter=50))
    accuracy = metrics.proxy_accuracy(cascade.score_rows(pool, model))
    return accuracy.select((F.col("proxy_accuracy") > 0.8).alias("learned"))


@query
def federated_average(spark, sf_dir):
    """The averaging half: every shard's mean vector stands for its weights."""
    rows = vectors(spark, sf_dir).select("shard", F.posexplode("embedding").alias("pos", "x"))
    means = rows.groupBy("shard", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    models = means.groupBy("shard").agg(
        F.transform(ordered, lambda item: item["m"]).alias("weights"),
        F.max(F.col("shard") / 2.0).alias("intercept"),
    )
    average = average_models(models)
    return average.select("intercept", F.posexplode("weights").alias("position", "weight")).select(
        "position", r9("weight", "weight"), r9("intercept", "intercept")
    )


def _strategy(name: str) -> Query:
    """The model of a run in one round, or every label of one in two rounds."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        strategy = STRATEGIES[name]
        result = _run(spark, sf_dir, name, 24, 2, clusters=6 if strategy.sharded else 24)
        if not strategy.recursive:
            return model_rows(spark, result.model)
        shard = F.col("shard") if strategy.sharded else F.lit(0).alias("shard")
        return result.ledger.select("id", shard, "label", "round")

    return run


for _name in ("lc2", "lc3", "lc4", "gc1", "gc2", "lc1rec", "lc2rec", "lc3rec", "lc4rec", "gc2rec"):
    QUERIES[_name] = _strategy(_name)


@query
def recursive_shards(spark, sf_dir):
    """Every round splits its budget evenly over the shards and spends it exactly."""
    ledger = _run(spark, sf_dir, "lc1rec", 32, 3, clusters=8).ledger
    return ledger.groupBy("round", "shard").agg(
        F.count("*").alias("labels"), F.count_distinct("id").alias("ids")
    )


@query
def naurac(spark, sf_dir):
    return _rounded(metrics.naurac(order_scores(spark, sf_dir), ["shard"], 3))


@query
def auc(spark, sf_dir):
    return _rounded(metrics.auc(order_tied_scores(spark, sf_dir), ["shard"], 3))


@query
def score_separation(spark, sf_dir):
    return _rounded(metrics.score_separation(order_scores(spark, sf_dir), ["shard"]))


@query
def zone_report(spark, sf_dir):
    return _rounded(cascade.zone_report(order_scores(spark, sf_dir), 0.2, 0.8))


@query
def accuracy_at_budget(spark, sf_dir):
    result = metrics.accuracy_at_budget(
        order_scores(spark, sf_dir), (0, 100, 10**9), (0.05, 0.3)
    )
    return _rounded(result)


@query
def call_reduction_at_fnr(spark, sf_dir):
    return _rounded(
        metrics.call_reduction_at_fnr(order_tied_scores(spark, sf_dir), (0.01, 0.05, 0.1, 0.5))
    )


@query
def certainty_mass(spark, sf_dir):
    return _rounded(metrics.certainty_mass(order_scores(spark, sf_dir), 0.2, ["shard"]))


@query
def confusion_report(spark, sf_dir):
    scored = order_scores(spark, sf_dir)
    predicted = scored.withColumn("prediction", scoring.predicted_label(F.col("score")))
    return _rounded(metrics.confusion_report(predicted, ["shard"]))


@query
def score_dump_join_(spark, sf_dir):
    scored = vector_scores(spark, sf_dir).select("id", "score")
    dump = score_dump_join(scored, gold(spark, sf_dir), scratch_path(spark, "scores"))
    return _rounded(dump)


@query
def calibrate_band(spark, sf_dir):
    scores = order_tied_scores(spark, sf_dir)
    return _rounded(metrics.calibrate_band(scores, (10, 2000, 6000, 10**9)))


def _seed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for runs: supplier group the cell, flag the setting, line number the seed."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 36).alias("cell"),
        F.col("l_returnflag").alias("setting"),
        F.col("l_linenumber").alias("seed"),
        F.col("l_quantity").alias("aurac"),
    )


@query
def seed_average(spark, sf_dir):
    ranked, _ = metrics.seed_average(_seed_results(spark, sf_dir), ["cell"], ["setting"], "aurac")
    return _rounded(ranked)


@query
def seed_wins(spark, sf_dir):
    return metrics.seed_average(_seed_results(spark, sf_dir), ["cell"], ["setting"], "aurac")[1]


# The names of the extension points; other functions carry a trailing underscore where they would
# hide an imported name.
EXTENSION_POINTS = {
    "sampler": "Sampler",
    "labeler": "Labeler",
    "function_labeler": "FunctionLabeler",
    "training_data_builder": "TrainingDataBuilder",
}
QUERIES = {
    EXTENSION_POINTS.get(name, name.rstrip("_")): function for name, function in QUERIES.items()
}
