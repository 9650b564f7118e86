"""Data checks: one aggregate of violation counts each, raised on the driver."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _width_columns() -> list[Column]:
    width = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    return [
        count_if(width == 0).alias("zero_width"),
        F.min(width).alias("min_width"),
        F.max(width).alias("max_width"),
    ]


def candidate_violations(
    df: DataFrame, unique_ids: bool = True, text_required: bool = False
) -> DataFrame:
    """One row of counts. Only the duplicate count needs a shuffle, of the ids alone."""
    counts = [
        F.count("*").alias("n_rows"),
        count_if(F.col("id").isNull()).alias("null_id"),
        count_if(F.col("embedding").isNull()).alias("null_embedding"),
        count_if(F.exists("embedding", lambda x: x.isNull())).alias("null_element"),
        *_width_columns(),
    ]
    if text_required:
        counts.append(count_if(F.col("text").isNull()).alias("null_text"))
    if unique_ids:
        counts.append((F.count("id") - F.count_distinct("id")).alias("duplicate_id"))
    return df.agg(*counts)


def _raise_on(counts: dict, what: str, names: tuple[str, ...]) -> None:
    broken = {name: counts[name] for name in names if counts.get(name)}
    if broken:
        raise ValueError(f"{what}: {broken}")


def require_valid_candidates(
    df: DataFrame, unique_ids: bool = True, text_required: bool = False
) -> dict:
    counts = candidate_violations(df, unique_ids, text_required).first().asDict()
    _raise_on(
        counts,
        "invalid candidates",
        ("null_id", "null_embedding", "null_element", "zero_width", "null_text", "duplicate_id"),
    )
    if counts["min_width"] != counts["max_width"]:
        raise ValueError("candidates mix embedding widths")
    return counts


def example_counts() -> list[Column]:
    """The counts of a training set ``(embedding, label)`` as aggregates."""
    not_finite = F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    return [
        F.count("*").alias("n_rows"),
        count_if(F.col("label") == 1).alias("positives"),
        count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1)).alias("bad_label"),
        count_if(F.col("embedding").isNull()).alias("null_embedding"),
        count_if(not_finite).alias("not_finite"),
        *_width_columns(),
    ]


def merged_counts(before: dict | None, more: dict) -> dict:
    """The :func:`example_counts` of two sets of rows together."""
    if before is None:
        return dict(more)
    least = [w for w in (before["min_width"], more["min_width"]) if w is not None]
    most = [w for w in (before["max_width"], more["max_width"]) if w is not None]
    summed = {name: before[name] + more[name] for name in before if not name.endswith("_width") or name == "zero_width"}
    return {**summed, "min_width": min(least, default=None), "max_width": max(most, default=None)}


def example_violations(df: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """Counts for a training set ``(embedding, label)``, per ``groups`` if there are any."""
    return df.groupBy(*groups).agg(*example_counts())


def require_valid_examples(counts: dict) -> None:
    """Raise for the counts of :func:`example_violations`."""
    if counts["n_rows"] == 0:
        raise ValueError("no training examples")
    _raise_on(
        counts,
        "invalid training examples",
        ("bad_label", "null_embedding", "not_finite", "zero_width"),
    )
    if counts["min_width"] != counts["max_width"]:
        raise ValueError("training examples mix embedding widths")


def selection_violations(selected: DataFrame, budget: int) -> DataFrame:
    """A selection must not be empty, repeat an id or pass the budget."""
    return selected.agg(
        F.count("*").alias("n_rows"),
        (F.count("*") - F.count_distinct("id")).alias("duplicate_id"),
        F.greatest(F.count("*") - F.lit(budget), F.lit(0)).alias("over_budget"),
    )


def label_violations(labeled: DataFrame, selected: DataFrame) -> DataFrame:
    """The labeler must return exactly the selected ids, each once."""
    asked = selected.select("id", F.lit(1).alias("_asked"), F.lit(0).alias("_times"))
    returned = labeled.select(
        "id",
        F.lit(0).alias("_asked"),
        F.lit(1).alias("_times"),
        F.col("label").isNull().cast("int").alias("_null"),
    )
    both = asked.withColumn("_null", F.lit(0)).unionByName(returned)
    per_id = both.groupBy("id").agg(
        *[F.sum(name).alias(name) for name in ("_asked", "_times", "_null")]
    )
    return per_id.agg(
        F.coalesce(F.sum("_asked"), F.lit(0)).alias("selected"),
        F.coalesce(F.sum("_times"), F.lit(0)).alias("returned"),
        count_if(F.col("_times") == 0).alias("missing"),
        count_if(F.col("_asked") == 0).alias("unexpected"),
        count_if(F.col("_times") > 1).alias("repeated"),
        F.coalesce(F.sum("_null"), F.lit(0)).alias("null_label"),
    )


def require_answers(labeled: DataFrame, asked: DataFrame) -> int:
    """The labeler must answer every asked id once; returns the number of answers."""
    counts = label_violations(labeled, asked).first().asDict()
    _raise_on(
        counts,
        "the labeler must return every selected id once",
        ("missing", "unexpected", "repeated", "null_label"),
    )
    if counts["selected"] != counts["returned"]:
        raise ValueError("duplicate ids in the selection")
    return counts["selected"]


def require_valid_labels(labeled: DataFrame, selected: DataFrame, budget: int) -> int:
    """Check selection and labels of one round; returns the number of labels."""
    answers = require_answers(labeled, selected)
    if answers > budget:
        raise ValueError(f"{answers} ids selected for a budget of {budget}")
    return answers


def _id_sums(id_: Column) -> list[Column]:
    """Sums of two 32-bit hashes of the ids, which tell multisets of ids apart."""
    pieces = [F.conv(F.substring(F.md5(id_), start, 8), 16, 10).cast("long") for start in (1, 9)]
    return [F.coalesce(F.sum(piece), F.lit(0)).alias(f"ids_{i}") for i, piece in enumerate(pieces)]


def label_counts() -> list[Column]:
    """Aggregates of labeled rows from which :func:`require_counted_labels` sees whether they answer
    the selected ids."""
    return [count_if(F.col("label").isNull()).alias("null_label"), *_id_sums(F.col("id"))]


def require_counted_labels(counts: dict, selected: list[str], labeled: DataFrame, budget: int) -> int:
    """The check of :func:`require_valid_labels` for ids the driver holds, by what the write of the
    labeled rows has counted; only a fault costs a job, which names it. Returns the labels."""
    if len(set(selected)) != len(selected):
        raise ValueError("duplicate ids in the selection")
    digests = [hashlib.md5(id_.encode()).hexdigest() for id_ in selected]
    wanted = [sum(int(d[start : start + 8], 16) for d in digests) for start in (0, 8)]
    if counts["null_label"] or counts["n_rows"] != len(selected) or wanted != [counts["ids_0"], counts["ids_1"]]:
        asked = labeled.sparkSession.createDataFrame([(id_,) for id_ in selected], "id string")
        require_answers(labeled, asked)
        raise ValueError("the labeler must return every selected id once")
    if len(selected) > budget:
        raise ValueError(f"{len(selected)} ids selected for a budget of {budget}")
    return len(selected)
