"""Run settings, their checks and the label-budget arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CENTRAL = "central"
FEDERATED = "federated"


@dataclass(frozen=True)
class DatasetSpec:
    """Column names of a candidate table."""

    id_col: str = "id"
    text_col: str = "text"
    embedding_col: str = "embedding"

    def __post_init__(self) -> None:
        names = (self.id_col, self.text_col, self.embedding_col)
        if not all(names) or len(set(names)) != len(names):
            raise ValueError("a dataset needs three different, non-empty column names")


@dataclass(frozen=True)
class ClusterOptions:
    """k-means size; in a sharded run the count is per shard.

    Passes stop early when no centre moves further than ``tolerance`` times the spread of the start
    centres, so the scale of the vectors does not matter; 0 stops only when nothing moves.

    ``start`` is ``"seeded"`` (rows in seeded order) or ``"oversampled"`` (rows far from those chosen
    so far, in ``start_rounds`` rounds of ``cluster_count`` rows, reduced to as many as are asked)."""

    cluster_count: int = 50
    max_iterations: int = 10
    tolerance: float = 1e-5
    start: str = "seeded"
    start_rounds: int = 4

    def __post_init__(self) -> None:
        if self.cluster_count <= 0 or self.max_iterations <= 0:
            raise ValueError("cluster_count and max_iterations must be positive")
        if not math.isfinite(self.tolerance) or self.tolerance < 0:
            raise ValueError("tolerance must be finite and not negative")
        if self.start not in ("seeded", "oversampled") or self.start_rounds <= 0:
            raise ValueError("start must be seeded or oversampled, in at least one round")


@dataclass(frozen=True)
class RunConfig:
    """One training run. ``shards`` lists the values of ``shard_col`` in quota order.

    ``check_table`` checks every row first, ids for duplicates with a shuffle of their own; without
    it the run still fails on any duplicate id it selects and on any bad row it trains on.
    """

    rounds: int = 1
    label_budget: int = 200
    initial_label_fraction: float = 0.2
    uncertainty_center_1: float = 0.5
    uncertainty_center_2: float = 0.5
    seed: int = 42
    dataset: DatasetSpec = field(default_factory=DatasetSpec)
    shard_col: str | None = None
    shards: tuple = ()
    placement: str = CENTRAL
    roll_over: bool = False
    check_table: bool = False

    def __post_init__(self) -> None:
        if self.rounds <= 0 or self.label_budget <= 0:
            raise ValueError("rounds and label_budget must be positive")
        if not 0.0 < self.initial_label_fraction <= 1.0:
            raise ValueError("initial_label_fraction must be in (0, 1]")
        for center in (self.uncertainty_center_1, self.uncertainty_center_2):
            if not math.isfinite(center) or not 0.0 <= center <= 1.0:
                raise ValueError("uncertainty centres must be finite and in [0, 1]")
        if self.placement not in (CENTRAL, FEDERATED):
            raise ValueError(f"unknown training placement {self.placement!r}")
        if self.shard_col is None and self.shards:
            raise ValueError("shards were listed without a shard column")
        if self.shard_col is not None and not self.shards:
            raise ValueError("a sharded run needs at least one shard")
        if self.shard_col is None and self.placement == FEDERATED:
            raise ValueError("federated training needs a sharded run")
        if len(set(self.shards)) != len(self.shards):
            raise ValueError("shard values must be unique")


def config_violations(
    rounds: Column, budget: Column, fraction: Column, center_1: Column, center_2: Column
) -> Column:
    """The run checks over a table of settings: how many of them a row breaks."""

    def bad_center(center: Column) -> Column:
        return center.isNull() | F.isnan(center) | (center < 0) | (center > 1)

    checks = [
        rounds <= 0,
        budget <= 0,
        (fraction <= 0) | (fraction > 1),
        bad_center(center_1),
        bad_center(center_2),
    ]
    return reduce(lambda total, check: total + F.when(check, 1).otherwise(0), checks, F.lit(0))


def initial_budget(config: RunConfig) -> int:
    """Labels requested in round 0."""
    if config.rounds == 1:
        return config.label_budget
    share = math.floor(config.label_budget * config.initial_label_fraction)
    return max(1, min(config.label_budget, share))


def recursive_budget(remaining: int, rounds_left: int) -> int:
    """Labels requested in a later round: an even share, rounded up."""
    return -(-remaining // rounds_left)


def shard_quotas(total: int, shards: tuple) -> dict:
    """Even split of one round's budget; the first shards take the remainder."""
    share, extra = divmod(total, len(shards))
    return {shard: share + (1 if index < extra else 0) for index, shard in enumerate(shards)}


def shard_budget(total: Column, index: Column, shards: int) -> Column:
    """:func:`shard_quotas` as a column expression over a shard's position."""
    return F.floor(total / shards) + F.when(index < total % shards, 1).otherwise(0)


def round_budgets(df: DataFrame, budget: str, rounds: int, fraction: float) -> DataFrame:
    """One row per round with labels to request, for every row's ``budget``.

    Rounding each later share up spreads the rest so that the first ``rest % (rounds - 1)``
    later rounds get one label more; rounds without labels give no row.
    """
    total = F.col(budget)
    if rounds == 1:
        return df.select("*", F.lit(0).alias("round"), total.cast("long").alias("requested"))
    first = F.greatest(F.lit(1), F.least(total, F.floor(total * F.lit(fraction))))
    later = rounds - 1
    rest = total - first
    position = F.col("round") - 1
    requested = F.when(F.col("round") == 0, first).otherwise(
        F.floor(rest / later) + F.when(position < rest % later, 1).otherwise(0)
    )
    return (
        df.where(total > 0)
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
        .withColumn("requested", requested.cast("long"))
        .where("requested > 0")
    )
