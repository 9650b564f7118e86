"""Filter a table by a costly predicate: proxy first, labeler only where the proxy is unsure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semproxy.config import RunConfig
from semproxy.functions.scoring import ACCEPT, ESCALATE, REJECT, ProxyModel
from semproxy.operators.cascade import route, score_batches
from semproxy.operators.checks import require_answers
from semproxy.operators.labeling import Labeler
from semproxy.operators.propagation import DirectLabels, TrainingDataBuilder
from semproxy.operators.sampling import RandomSampler, Sampler
from semproxy.operators.training import LogisticTrainer
from semproxy.plans.runner import run_proxy_training
from semproxy.session import written
from semproxy.sources.candidates import load_candidates


def apply_filter(
    candidates: DataFrame,
    model: ProxyModel,
    labeler: Labeler,
    reject: float,
    accept: float,
    known: DataFrame | None = None,
) -> DataFrame:
    """Accepted rows plus escalated rows whose label is positive, with ``score`` and ``zone``.

    Every row is scored once, in one pass that writes the rows not rejected. Only escalated rows
    without a ``known`` label ``(id, label)`` reach the labeler, once; it must answer each of them,
    else this fails rather than drop rows. Ids must not repeat among escalated rows.
    """
    scored = score_batches(candidates, model)
    open_rows = written(route(scored, reject, accept).where(F.col("zone") != REJECT), "routed")
    accepted = open_rows.where(F.col("zone") == ACCEPT)
    escalated = open_rows.where(F.col("zone") == ESCALATE)
    asked = escalated
    answers = []
    if known is not None:
        known = known.select("id", F.col("label").cast("int").alias("label"))
        answers.append(known)
        asked = escalated.join(known, "id", "left_anti")
    labeled = written(labeler.label(asked).select("id", F.col("label").cast("int").alias("label")), "answers")
    require_answers(labeled, asked)
    answers.append(labeled)
    positive = reduce(DataFrame.unionByName, answers).where("label = 1").select("id")
    return accepted.unionByName(escalated.join(positive, "id", "left_semi"))


def semantic_filter(
    table: DataFrame,
    labeler: Labeler,
    config: RunConfig = RunConfig(),
    band: tuple[float, float] = (0.2, 0.8),
    sampler: Sampler = RandomSampler(),
    builder: TrainingDataBuilder = DirectLabels(),
    trainer: LogisticTrainer = LogisticTrainer(),
) -> DataFrame:
    """Train a proxy within the label budget, then filter ``table`` through the cascade."""
    result = run_proxy_training(table, config, sampler, labeler, builder, trainer)
    candidates = load_candidates(table, config.dataset)
    return apply_filter(candidates, result.model, labeler, *band, known=result.ledger)
