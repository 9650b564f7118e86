"""The named training strategies."""

from __future__ import annotations

from dataclasses import dataclass

from semproxy.config import CENTRAL, FEDERATED, ClusterOptions
from semproxy.operators.propagation import (
    ClusterPropagation,
    DirectLabels,
    TrainingDataBuilder,
)
from semproxy.operators.sampling import ClusterSampler, RandomSampler, Sampler


@dataclass(frozen=True)
class Strategy:
    clustered: bool
    propagated: bool = False
    sharded: bool = False
    placement: str = CENTRAL
    recursive: bool = False

    def sampler(self, options: ClusterOptions = ClusterOptions()) -> Sampler:
        return ClusterSampler(options) if self.clustered else RandomSampler()

    def builder(self) -> TrainingDataBuilder:
        return ClusterPropagation() if self.propagated else DirectLabels()


def _strategies() -> dict[str, Strategy]:
    """lc1..lc4 cluster inside shards, gc1 and gc2 over the whole table, random_sharded draws its
    quota in each shard; ``rec`` is recursive."""
    named = {
        "random": Strategy(clustered=False),
        "recursive": Strategy(False, recursive=True),
        "random_sharded": Strategy(False, sharded=True),
        "recursive_sharded": Strategy(False, sharded=True, recursive=True),
    }
    for suffix, recursive in (("", False), ("rec", True)):
        for number in (1, 2, 3, 4):
            named[f"lc{number}{suffix}"] = Strategy(
                clustered=True,
                propagated=number in (2, 4),
                sharded=True,
                placement=FEDERATED if number in (3, 4) else CENTRAL,
                recursive=recursive,
            )
        named[f"gc1{suffix}"] = Strategy(clustered=True, recursive=recursive)
        named[f"gc2{suffix}"] = Strategy(clustered=True, propagated=True, recursive=recursive)
    return named


STRATEGIES = _strategies()
