"""Round-0 samplers and the uncertainty selection of later rounds."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semproxy.config import ClusterOptions, shard_quotas
from semproxy.functions.scoring import ProxyModel, predict_probability, seeded_key, uncertainty
from semproxy.operators.clustering import (
    Partition,
    cluster_representatives,
    kmeans_partition,
    sharded_kmeans,
)
from semproxy.operators.topk import place_of_hex, place_of_share, top_k, top_k_per_group
from semproxy.session import cut_lineage, written


@dataclass(frozen=True)
class Selection:
    ids: DataFrame
    partition: Partition | None = None


class Sampler(Protocol):
    """User extension point: pick at most ``budget`` rows of ``pool`` for round 0.

    ``pool`` has ``id`` and ``embedding``; with ``shards`` also ``shard_col``, and the budget is
    split evenly over the shards.
    """

    creates_clusters: bool

    def select_initial(
        self,
        pool: DataFrame,
        budget: int,
        seed: int,
        shard_col: str | None = None,
        shards: tuple = (),
    ) -> Selection: ...


def sample_random(
    pool: DataFrame,
    budget: int,
    seed: int,
    shard_col: str | None = None,
    shards: tuple = (),
) -> DataFrame:
    """Seed-stable random ids; rows with a NULL id are left out."""
    key = seeded_key(F.col("id"), seed)
    order, place = [key, F.col("id")], place_of_hex(key)
    named = pool.where(F.col("id").isNotNull())
    if shard_col is None:
        return top_k(named.select("id"), order, budget, place)
    ids = named.select("id", shard_col)
    return top_k_per_group(ids, shard_col, order, shard_quotas(budget, shards), place)


def select_uncertain(
    unlabeled: DataFrame,
    model: ProxyModel,
    budget: int,
    center_1: float = 0.5,
    center_2: float = 0.5,
    shard_col: str | None = None,
    shards: tuple = (),
) -> DataFrame:
    """The ``budget`` rows whose score is nearest either centre, with their distance."""
    keep = () if shard_col is None else (shard_col,)
    score = predict_probability(F.col("embedding"), model).alias("score")
    distance = uncertainty(F.col("score"), center_1, center_2).alias("u")
    scored = unlabeled.select("id", *keep, score)
    # Counting and taking read narrow rows; the pool is read and scored once.
    ranked = written(scored.select("id", *keep, distance), "ranked")
    order, place = [F.col("u").asc(), F.col("id").asc()], place_of_share(F.col("u"))
    if shard_col is None:
        return top_k(ranked, order, budget, place)
    return top_k_per_group(ranked, shard_col, order, shard_quotas(budget, shards), place)


@dataclass(frozen=True)
class RandomSampler:
    creates_clusters: bool = field(default=False, init=False)

    def select_initial(self, pool, budget, seed, shard_col=None, shards=()):
        return Selection(sample_random(pool, budget, seed, shard_col, shards))


@dataclass(frozen=True)
class ClusterSampler:
    """Labels cluster representatives; if they pass the budget, a seeded subset of them."""

    options: ClusterOptions = ClusterOptions()
    creates_clusters: bool = field(default=True, init=False)

    def select_initial(self, pool, budget, seed, shard_col=None, shards=()):
        if shard_col is None:
            partition = kmeans_partition(pool, self.options, seed)
        else:
            partition = sharded_kmeans(pool, shard_col, shards, self.options, seed)
        if partition is None:
            return Selection(pool.select("id").limit(0))
        found = cluster_representatives(partition.assign(pool), partition.keys)
        representatives = cut_lineage(found)  # one row per cluster
        return Selection(
            subset_representatives(representatives, budget, seed, shard_col, shards), partition
        )


def subset_representatives(
    representatives: DataFrame,
    budget: int,
    seed: int,
    shard_col: str | None = None,
    shards: tuple = (),
) -> DataFrame:
    """All representatives within the budget, else the first ones in seeded order."""
    return sample_random(representatives, budget, seed, shard_col, shards)
