"""Label-efficient semantic filtering of large tables on Spark DataFrames."""

from semproxy.config import ClusterOptions, DatasetSpec, RunConfig
from semproxy.functions.scoring import ProxyModel
from semproxy.operators.labeling import FunctionLabeler, GoldLabeler
from semproxy.operators.propagation import ClusterPropagation, DirectLabels
from semproxy.operators.sampling import ClusterSampler, RandomSampler
from semproxy.plans.runner import TrainingResult, run_proxy_training
from semproxy.plans.semantic_filter import semantic_filter

__all__ = [
    "ClusterOptions",
    "ClusterPropagation",
    "ClusterSampler",
    "DatasetSpec",
    "DirectLabels",
    "FunctionLabeler",
    "GoldLabeler",
    "ProxyModel",
    "RandomSampler",
    "RunConfig",
    "TrainingResult",
    "run_proxy_training",
    "semantic_filter",
]
