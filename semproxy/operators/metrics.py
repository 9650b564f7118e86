"""Quality of scored rows ``(id, label, score)``, optionally per ``groups`` column.

Counts that need an order come from :func:`running_totals`; measures that depend on score values
only are first aggregated to one row per distinct score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semproxy.functions.scoring import confidence, predicted_label
from semproxy.operators.checks import count_if
from semproxy.operators.prefix import running_totals

Groups = list[str] | tuple[str, ...]

# The two cascade bands every evaluation reports.
BANDS = ((0.2, 0.8), (0.1, 0.9))

EULER_GAMMA = 0.5772156649015329


def is_correct(score: Column, label: Column) -> Column:
    """1 where the proxy's own prediction equals the label."""
    return F.when(predicted_label(score) == label, 1).otherwise(0)


def proxy_accuracy(scores: DataFrame, groups: Groups = ()) -> DataFrame:
    correct = is_correct(F.col("score"), F.col("label"))
    return scores.groupBy(*groups).agg(F.avg(correct).alias("proxy_accuracy"))


def ranked_by_confidence(
    scores: DataFrame, groups: Groups, max_groups: int | None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Rows from most to least confident, ties by id, with the number kept and correct so far."""
    rows = scores.select(
        *groups,
        "id",
        *[name for name in keep if name != "id"],
        confidence(F.col("score")).alias("confidence"),
        is_correct(F.col("score"), F.col("label")).alias("correct"),
        F.lit(1).alias("row"),
    )
    order = [F.col("confidence").desc(), F.col("id").asc()]
    return running_totals(rows, order, ["row", "correct"], groups, max_groups, list(keep))


def risk_coverage_curve(
    scores: DataFrame, groups: Groups = (), max_groups: int | None = None
) -> DataFrame:
    """Accuracy of every kept prefix in order of confidence, ties by id."""
    return ranked_by_confidence(scores, groups, max_groups, ("id",)).select(
        *groups,
        "id",
        F.col("run_row").alias("kept"),
        (F.col("run_row") / F.col("total_row")).alias("coverage"),
        (F.col("run_correct") / F.col("run_row")).alias("accuracy"),
    )


def aurac(scores: DataFrame, groups: Groups = (), max_groups: int | None = None) -> DataFrame:
    """Mean accuracy over all prefixes of the risk-coverage curve."""
    ranked = ranked_by_confidence(scores, groups, max_groups)
    accuracy = F.col("run_correct") / F.col("run_row")
    return ranked.groupBy(*groups).agg(F.avg(accuracy).alias("aurac"))


def harmonic(n: Column) -> Column:
    """H(n) for n >= 0: exact up to 64, then its asymptotic series (error below 1e-15)."""
    exact = F.when(
        n > 0,
        F.aggregate(
            F.sequence(F.lit(1), F.least(n, F.lit(64)).cast("int")),
            F.lit(0.0),
            lambda total, i: total + 1.0 / i,
        ),
    ).otherwise(F.lit(0.0))
    series = (
        F.log(n.cast("double"))
        + F.lit(EULER_GAMMA)
        + 1 / (2.0 * n)
        - 1 / (12.0 * n * n)
        + 1 / (120.0 * n * n * n * n)
    )
    return F.when(n <= 64, exact).otherwise(series)


def oracle_aurac(rows: Column, correct: Column) -> Column:
    """Area under the ideal curve, which keeps all ``correct`` rows first."""
    return (correct + correct * (harmonic(rows) - harmonic(correct))) / rows


def naurac(scores: DataFrame, groups: Groups = (), max_groups: int | None = None) -> DataFrame:
    """AURAC rescaled so that the positive base rate is 0 and the ideal curve is 1."""
    ranked = ranked_by_confidence(scores, groups, max_groups, ("label",))
    totals = ranked.groupBy(*groups).agg(
        F.count("*").alias("n"),
        count_if(F.col("label") == 1).alias("k"),
        F.avg(F.col("run_correct") / F.col("run_row")).alias("aurac"),
    )
    base = F.col("k") / F.col("n")
    ideal = oracle_aurac(F.col("n"), F.col("k"))
    return totals.select(
        *groups,
        "aurac",
        base.alias("base_rate"),
        ideal.alias("oracle_aurac"),
        F.when(ideal > base, (F.col("aurac") - base) / (ideal - base)).alias("naurac"),
    )


def _per_score(scores: DataFrame, groups: Groups, max_groups: int | None) -> DataFrame:
    """One row per distinct score with running counts; equal scores meet before the shuffle."""
    distinct = scores.groupBy(*groups, "score").agg(
        count_if(F.col("label") == 1).alias("pos"), F.count("*").alias("row")
    )
    return running_totals(distinct, [F.col("score").asc()], ["pos", "row"], groups, max_groups)


def auc(scores: DataFrame, groups: Groups = (), max_groups: int | None = None) -> DataFrame:
    """Chance that a positive outscores a negative; equal scores count one half."""
    negatives_below = (F.col("run_row") - F.col("row")) - (F.col("run_pos") - F.col("pos"))
    negatives_level = F.col("row") - F.col("pos")
    won = F.col("pos") * (negatives_below + negatives_level / 2)
    pairs = F.first("total_pos").cast("double") * (F.first("total_row") - F.first("total_pos"))
    return (
        _per_score(scores, groups, max_groups)
        .groupBy(*groups)
        .agg(F.when(pairs > 0, F.sum(won) / pairs).alias("auc"))
    )


def score_separation(scores: DataFrame, groups: Groups = ()) -> DataFrame:
    """Mean score of the positives minus that of the negatives."""
    positive = F.avg(F.when(F.col("label") == 1, F.col("score")))
    negative = F.avg(F.when(F.col("label") == 0, F.col("score")))
    return scores.groupBy(*groups).agg((positive - negative).alias("separation"))


def certainty_mass(scores: DataFrame, margin: float = 0.2, groups: Groups = ()) -> DataFrame:
    """Share of rows at least ``margin`` away from 0.5."""
    certain = F.when(confidence(F.col("score")) >= F.lit(margin), 1).otherwise(0)
    return scores.groupBy(*groups).agg(F.avg(certain).alias("certainty_mass"))


def confusion_report(predictions: DataFrame, groups: Groups = ()) -> DataFrame:
    """Counts, precision, recall and accuracy of ``prediction`` against ``label``."""
    hit = F.col("prediction") == 1
    true = F.col("label") == 1
    counts = predictions.groupBy(*groups).agg(
        count_if(hit & true).alias("tp"),
        count_if(hit & ~true).alias("fp"),
        count_if(~hit & true).alias("fn"),
        count_if(~hit & ~true).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(name) for name in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "*",
        F.when(tp + fp > 0, tp / (tp + fp)).alias("precision"),
        F.when(tp + fn > 0, tp / (tp + fn)).alias("recall"),
        ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
    )


def accuracy_at_budget(
    scores: DataFrame,
    budgets: list[int] | tuple[int, ...] = (),
    fractions: list[float] | tuple[float, ...] = (),
    groups: Groups = (),
    max_groups: int | None = None,
) -> DataFrame:
    """Accuracy when exactly the B least confident rows go to a perfect labeler.

    ``budgets`` are row counts, ``fractions`` shares of the rows, rounded down.
    """
    rows = F.col("total_row")
    chosen = [F.least(F.lit(b).cast("long"), rows) for b in budgets]
    chosen += [F.floor(rows * F.lit(f)) for f in fractions]
    names = [float(b) for b in budgets] + [float(f) for f in fractions]
    kept_correct = [
        F.coalesce(F.max(F.when(F.col("run_row") == rows - b, F.col("run_correct"))), F.lit(0))
        for b in chosen
    ]
    aggregates = []
    for index, (b, kept) in enumerate(zip(chosen, kept_correct)):
        aggregates.append(F.max(b).alias(f"_b{index}"))
        aggregates.append(kept.alias(f"_k{index}"))
    wide = ranked_by_confidence(scores, groups, max_groups).groupBy(*groups).agg(
        F.max("total_row").alias("_n"), *aggregates
    )
    lines = [
        F.struct(
            F.lit(name).alias("budget"),
            F.col(f"_b{index}").alias("escalated"),
            ((F.col(f"_k{index}") + F.col(f"_b{index}")) / F.col("_n")).alias("accuracy"),
        )
        for index, name in enumerate(names)
    ]
    return wide.select(*groups, F.inline(F.array(*lines)))


def call_reduction_at_fnr(
    scores: DataFrame,
    alphas: list[float] | tuple[float, ...],
    groups: Groups = (),
    max_groups: int | None = None,
) -> DataFrame:
    """Per ``alpha``: the largest threshold t with FNR(score < t) <= alpha, and the rows below."""
    below_pos = F.col("run_pos") - F.col("pos")
    below_rows = F.col("run_row") - F.col("row")
    aggregates = [F.max("total_row").alias("_n")]
    for index, alpha in enumerate(alphas):
        allowed = below_pos <= F.lit(alpha) * F.col("total_pos")
        aggregates.append(F.max(F.when(allowed, F.col("score"))).alias(f"_t{index}"))
        aggregates.append(F.max(F.when(allowed, below_rows)).alias(f"_r{index}"))
    wide = _per_score(scores, groups, max_groups).groupBy(*groups).agg(*aggregates)
    lines = [
        F.struct(
            F.lit(float(alpha)).alias("alpha"),
            F.col(f"_t{index}").alias("threshold"),
            (F.col(f"_r{index}") / F.col("_n")).alias("reduction"),
        )
        for index, alpha in enumerate(alphas)
    ]
    return wide.select(*groups, F.inline(F.array(*lines)))


def calibrate_band(
    scores: DataFrame,
    budgets: list[int] | tuple[int, ...],
    groups: Groups = (),
    max_groups: int | None = None,
) -> DataFrame:
    """Per budget B, the widest band around 0.5 that escalates at most B rows.

    Rows of one confidence stay together. Both bounds are scores of kept rows (or beyond every
    score), so routing by the band escalates exactly the counted rows.
    """
    level = scores.select(*groups, "score", confidence(F.col("score")).alias("confidence"))
    distinct = level.groupBy(*groups, "confidence").agg(
        F.count("*").alias("row"),
        F.max(F.when(F.col("score") < 0.5, F.col("score"))).alias("low"),
        F.min(F.when(F.col("score") >= 0.5, F.col("score"))).alias("high"),
    )
    below = F.col("run_row") - F.col("row")
    ranked = running_totals(distinct, [F.col("confidence").asc()], ["row"], groups, max_groups)
    ranked = ranked.withColumn("_below", below)
    aggregates = []
    for index, budget in enumerate(budgets):
        # The kept rows are the levels from the last one with at most B rows below it.
        kept = F.col("run_row") > budget
        aggregates += [
            F.min(F.when(kept, F.struct("confidence", "_below"))).alias(f"_c{index}"),
            F.max(F.when(kept, F.col("low"))).alias(f"_l{index}"),
            F.min(F.when(kept, F.col("high"))).alias(f"_h{index}"),
        ]
    wide = ranked.groupBy(*groups).agg(F.max("total_row").alias("_n"), *aggregates)
    lines = [
        F.struct(
            F.lit(budget).cast("long").alias("budget"),
            F.coalesce(F.col(f"_l{index}"), F.lit(-1.0)).alias("reject"),
            F.coalesce(F.col(f"_h{index}"), F.lit(2.0)).alias("accept"),
            F.coalesce(F.col(f"_c{index}._below"), F.col("_n")).alias("escalations"),
        )
        for index, budget in enumerate(budgets)
    ]
    return wide.select(*groups, F.inline(F.array(*lines)))


def seed_average(
    results: DataFrame, cell: list[str], config: list[str], metric: str
) -> tuple[DataFrame, DataFrame]:
    """Mean over seeds per cell and configuration with its rank, and wins per configuration.

    Configurations that share the best mean of a cell all win it.
    """
    means = results.groupBy(*cell, *config).agg(F.avg(metric).alias("mean"))
    window = Window.partitionBy(*cell).orderBy(F.col("mean").desc())
    ranked = means.withColumn("rank", F.rank().over(window))
    wins = ranked.groupBy(*config).agg(count_if(F.col("rank") == 1).alias("wins"))
    return ranked, wins
