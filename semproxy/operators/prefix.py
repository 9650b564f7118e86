"""Running totals over a global order, without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semproxy.session import cut_lineage, shuffle_partitions, small


def running_totals(
    df: DataFrame,
    order: list[Column],
    values: list[str],
    groups: list[str] | tuple[str, ...] = (),
    max_groups: int | None = None,
    keep: list[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``run_<v>`` (running total up to the row) and ``total_<v>`` for integer ``values``.

    ``order`` must be total within a group. Rows are range partitioned by group and order and
    written once: because the order is total, many rows with one leading value still spread over
    several partitions. Each partition is summed in order as it streams past, and the totals of
    the partitions before it, at most one row per partition and group start, are added on.
    ``groups`` hold no NULL; a known ``max_groups`` lets those totals be broadcast. ``keep`` names
    the other columns still needed once the order is fixed, all by default.
    """
    groups = list(groups)
    kept = list(df.columns) if keep is None else list(dict.fromkeys([*groups, *values, *keep]))
    count = partitions or shuffle_partitions(df.sparkSession)
    # Without a given number, adaptive execution may merge neighbouring small partitions.
    number = [] if partitions is None else [partitions]
    keys = [F.col(name).asc() for name in groups]
    # Range partitioning reads its input twice; what lies above it is computed only once.
    rows = df.withColumns({f"run_{v}": F.col(v).cast("long") for v in values}).persist()
    try:
        ranged = cut_lineage(
            rows.repartitionByRange(*number, *keys, *order)
            .sortWithinPartitions(*keys, *order)
            .select(*kept, *[f"run_{v}" for v in values], F.spark_partition_id().alias("_part"))
        )
    finally:
        rows.unpersist()
    sums = ranged.groupBy("_part", *groups).agg(
        *[F.sum(f"run_{v}").alias(f"_sum_{v}") for v in values]
    )
    earlier_parts = (
        Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier_groups = (
        Window.partitionBy("_part").orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)
    )
    whole_group = Window.partitionBy(*groups)
    columns: list[Column] = []
    for v in values:
        offset = F.coalesce(F.sum(f"_sum_{v}").over(earlier_parts), F.lit(0))
        if groups:
            offset = offset - F.coalesce(F.sum(f"_sum_{v}").over(earlier_groups), F.lit(0))
        columns.append(offset.alias(f"_offset_{v}"))
        columns.append(F.sum(f"_sum_{v}").over(whole_group).alias(f"total_{v}"))
    offsets = sums.select("_part", *groups, *columns)
    if not groups or max_groups is not None:
        offsets = small(offsets, count + (max_groups or 0), 64 + 32 * len(values))

    positions = [ranged.columns.index(f"run_{v}") for v in values]

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = [0] * len(positions)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            arrays = list(batch.columns)
            for slot, position in enumerate(positions):
                arrays[position] = pc.cumulative_sum(
                    arrays[position], start=pa.scalar(carried[slot], pa.int64())
                )
                carried[slot] = arrays[position][-1].as_py()
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    schema = T.StructType(ranged.schema.fields)
    summed = ranged.mapInArrow(accumulate, schema)
    result = summed.join(offsets, ["_part", *groups])
    return result.select(
        *kept,
        *[(F.col(f"run_{v}") + F.col(f"_offset_{v}")).alias(f"run_{v}") for v in values],
        *[f"total_{v}" for v in values],
    )
