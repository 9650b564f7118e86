"""Three-zone routing of scored rows and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semproxy.functions.scoring import (
    ACCEPT,
    REJECT,
    ProxyModel,
    batch_probabilities,
    predict_probability,
    predicted_label,
    projected_latency,
    zone,
)
from semproxy.operators.checks import count_if
from semproxy.operators.metrics import BANDS, Groups


def score_rows(rows: DataFrame, model: ProxyModel) -> DataFrame:
    """Rows with their ``score``; batch or streaming."""
    return rows.withColumn("score", predict_probability(F.col("embedding"), model))


def score_batches(rows: DataFrame, model: ProxyModel) -> DataFrame:
    """The same ``score``, computed once per row whatever reads it later."""
    scores = batch_probabilities(F.col("embedding"), [model])
    return rows.withColumn("score", F.element_at(scores, 1))


def route(scored: DataFrame, reject: float, accept: float) -> DataFrame:
    """Scored rows with their ``zone``; batch or streaming."""
    return scored.withColumn("zone", zone(F.col("score"), reject, accept))


def cascade_summary(
    scores: DataFrame, bands: tuple[tuple[float, float], ...] = BANDS, groups: Groups = ()
) -> DataFrame:
    """Escalations and final accuracy per band, with escalated rows answered correctly.

    All bands are counted in one pass over the rows.
    """
    aggregates = []
    for index, (reject, accept) in enumerate(bands):
        where = zone(F.col("score"), reject, accept)
        correct = (
            F.when(where == REJECT, F.col("label") == 0)
            .when(where == ACCEPT, F.col("label") == 1)
            .otherwise(F.lit(True))
        )
        escalated = ~where.isin(REJECT, ACCEPT)
        aggregates.append(count_if(escalated).alias(f"_e{index}"))
        aggregates.append(F.avg(F.when(correct, 1).otherwise(0)).alias(f"_a{index}"))
    lines = [
        F.struct(
            F.lit(float(reject)).alias("reject"),
            F.lit(float(accept)).alias("accept"),
            F.col(f"_e{index}").alias("escalations"),
            F.col(f"_a{index}").alias("final_accuracy"),
        )
        for index, (reject, accept) in enumerate(bands)
    ]
    return scores.groupBy(*groups).agg(*aggregates).select(*groups, F.inline(F.array(*lines)))


def zone_report(
    scores: DataFrame, reject: float, accept: float, groups: Groups = ()
) -> DataFrame:
    """Rows, share and correctness of every zone that has rows."""
    prediction = (
        F.when(F.col("zone") == REJECT, 0)
        .when(F.col("zone") == ACCEPT, 1)
        .otherwise(predicted_label(F.col("score")))
    )
    correct = F.when(prediction == F.col("label"), 1).otherwise(0)
    zones = (
        route(scores, reject, accept)
        .groupBy(*groups, "zone")
        .agg(F.count("*").alias("n_rows"), F.avg(correct).alias("correctness"))
    )
    # At most three rows per group are left to share out.
    share = F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(*groups))
    return zones.withColumn("mass", share)


def total_calls(summary: DataFrame, labels: str = "labels") -> DataFrame:
    """Labels bought plus escalations, and the seconds these calls take at the known rates."""
    calls = F.col(labels) + F.col("escalations")
    seconds = projected_latency(calls)
    return summary.select(
        "*",
        calls.alias("total_calls"),
        *[column.alias(f"{name}_seconds") for name, column in seconds.items()],
    )
