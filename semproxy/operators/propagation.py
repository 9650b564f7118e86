"""Training-data builders: direct labels, or labels spread over clusters."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semproxy.operators.checks import count_if
from semproxy.operators.clustering import Partition
from semproxy.session import cut_lineage, small


class TrainingDataBuilder(Protocol):
    """User extension point: rows with ``id``, ``embedding`` and ``label`` to train on.

    ``direct`` holds every label bought so far, ``pool`` all rows, ``partition`` the clusters
    of round 0; unused inputs are never computed.
    """

    needs_clusters: bool

    def build(
        self, direct: DataFrame, pool: DataFrame, partition: Partition | None
    ) -> DataFrame: ...


def assign_join(rows: DataFrame, assignments: DataFrame) -> DataFrame:
    """Rows with their cluster; rows without an assignment are skipped."""
    return rows.join(assignments.select("id", "cluster"), "id")


def cluster_votes(labeled: DataFrame, keys: tuple[str, ...] = ("cluster",)) -> DataFrame:
    """Direct labels per cluster; anything but 1 counts as negative."""
    return labeled.groupBy(*keys).agg(
        count_if(F.col("label") == 1).alias("positives"),
        count_if(F.coalesce(F.col("label") != 1, F.lit(True))).alias("negatives"),
    )


def majority_label(positives: Column, negatives: Column) -> Column:
    """Majority of the votes; ties are positive."""
    return F.when(positives >= negatives, 1).otherwise(0)


def covered_clusters(
    assigned: DataFrame, votes: DataFrame, keys: tuple[str, ...], clusters: int
) -> DataFrame:
    """Rows of clusters that have a vote, with the votes; ``clusters`` bounds the votes."""
    return assigned.join(small(votes, clusters, 64), list(keys))


def propagated_training_set(
    assigned: DataFrame, votes: DataFrame, keys: tuple[str, ...], clusters: int
) -> DataFrame:
    """Every row of a covered cluster with the majority label, also directly labeled rows."""
    label = majority_label(F.col("positives"), F.col("negatives"))
    covered = covered_clusters(assigned, votes, keys, clusters)
    shards = [key for key in keys if key != "cluster"]
    return covered.select("id", "embedding", *shards, label.alias("label"))


@dataclass(frozen=True)
class DirectLabels:
    needs_clusters: bool = field(default=False, init=False)

    def build(self, direct, pool, partition):
        return direct


@dataclass(frozen=True)
class ClusterPropagation:
    needs_clusters: bool = field(default=True, init=False)

    def build(self, direct, pool, partition):
        if partition is None:
            raise ValueError("cluster propagation needs a sampler that creates clusters")
        # One row per voted cluster, read by every pass of the training.
        votes = cut_lineage(cluster_votes(partition.assign(direct), partition.keys))
        return propagated_training_set(
            partition.assign(pool), votes, partition.keys, partition.clusters
        )
