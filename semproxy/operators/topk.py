"""Exact top-k and per-group top-k that never sort a whole pool.

The leading order column is mapped to a place, a small integer that grows with it. One aggregate
counts the rows per place, which shows the place where the k-th row lies: rows of earlier places
are taken as they are, and only the rows of that one place are ordered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semproxy.operators.prefix import running_totals

PLACES = 1 << 16

# Up to so many rows of the last place are ordered by one window; more are ranked in ranges.
SORTED_ROWS = 50_000


def place_of_hex(key: Column) -> Column:
    """Place of a hexadecimal key by its first four digits."""
    return F.conv(F.substring(key, 1, 4), 16, 10).cast("int")


def place_of_share(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Place of a number in ``[low, high]``; NULL and NaN come last."""
    last = F.lit(PLACES - 1)
    if high <= low:
        return F.lit(0)
    share = F.floor((value - F.lit(low)) * F.lit(PLACES / (high - low)))
    inside = F.least(last, F.greatest(F.lit(0), share.cast("int")))
    return F.when(value.isNull() | F.isnan(value.cast("double")), last).otherwise(inside)


def _first(
    df: DataFrame, group: str | None, order: list[Column], place: Column, quotas: dict
) -> DataFrame:
    """The first ``quotas[g]`` rows of every group; ``group`` None has the one key None."""
    keys = [] if group is None else [group]
    placed = df.withColumn("_place", place)
    counts = placed.groupBy(*keys, "_place").agg(F.count("*").alias("_n"))
    # At most PLACES rows per group; each group gives back the one row where its quota ends.
    window = Window.partitionBy(*keys).orderBy("_place")
    summed = counts.withColumn("_up_to", F.sum("_n").over(window))
    before = F.col("_up_to") - F.col("_n")
    quota = _chain(group, quotas)
    ends = summed.where((before < quota) & (F.col("_up_to") >= quota)).collect()
    cuts = {None if group is None else row[group]: row for row in ends}
    cut = _chain(group, {g: cuts[g]["_place"] if g in cuts else PLACES for g in quotas})
    below = placed.where(F.col("_place") < cut).select(*df.columns)
    if not cuts:
        return below
    left = {g: quotas[g] - (row["_up_to"] - row["_n"]) for g, row in cuts.items()}
    last = placed.where(F.col("_place") == cut)
    if max(row["_n"] for row in cuts.values()) <= SORTED_ROWS:
        ranked = last.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        ones = last.withColumn("_one", F.lit(1))
        ranked = running_totals(ones, order, ["_one"], keys, len(cuts), keep=df.columns)
        ranked = ranked.withColumnRenamed("run__one", "_rank")
    return below.unionByName(ranked.where(F.col("_rank") <= _chain(group, left)).select(*df.columns))


def _chain(group: str | None, values: dict) -> Column:
    """``values[group]`` as a column; few values are distinct, so there are few branches."""
    if group is None:
        return F.lit(values[None])
    by_value: dict = {}
    for key, value in values.items():
        by_value.setdefault(value, []).append(key)
    start = F.when(F.lit(False), F.lit(0))
    return reduce(
        lambda chain, item: chain.when(F.col(group).isin(item[1]), item[0]), by_value.items(), start
    )


def top_k(df: DataFrame, order: list[Column], k: int, place: Column) -> DataFrame:
    """The first ``k`` rows in a total ``order``; ``place`` must not fall along it."""
    return _first(df, None, order, place, {None: k}) if k > 0 else df.limit(0)


def top_k_per_group(
    df: DataFrame, group: str, order: list[Column], quotas: dict, place: Column
) -> DataFrame:
    """The first ``quotas[g]`` rows of each group ``g`` in a total ``order``."""
    wanted = {value: quota for value, quota in quotas.items() if quota > 0}
    if not wanted:
        return df.limit(0)
    pool = df.where(F.col(group).isin(list(wanted)))
    return _first(pool, group, order, place, wanted)
