"""Labelers, the fetch of selected rows and the ledger of labeled ids."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semproxy.operators.bloom import BloomFilter, bloom_filter
from semproxy.session import checkpoint_dir, cut_lineage, is_bucketed, is_small, shuffle_partitions, written

# More rows than any broadcast holds: what an unknown number of ids counts as.
UNKNOWN = 1 << 62


class Labeler(Protocol):
    """User extension point: adds an int ``label`` column to every candidate row.

    Candidates have ``id``, ``text`` and ``embedding``, and maybe further columns to keep.
    """

    def label(self, candidates: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class FunctionLabeler:
    """Calls ``function(row)`` for every candidate, in batches inside the tasks.

    Calls run where the rows were read; ``tasks`` spreads slow calls of a small selection. With
    ``log`` answers are kept by id in the shared folder, ``batch`` of them at a time, so that a task
    that is run again asks only for what it had not yet written. Candidates are then placed and
    ordered by id, whatever way they come. ``log`` names the answers of one run of the function:
    another labeler with the same name takes them over.
    """

    function: Callable[[Any], int]
    tasks: int | None = None
    log: str | None = None
    batch: int = 64

    def __post_init__(self) -> None:
        if self.function is None:
            raise ValueError("a function labeler needs a function")
        if self.batch < 1:
            raise ValueError("a batch of answers holds at least one")

    def label(self, candidates: DataFrame) -> DataFrame:
        function, size = self.function, self.batch
        answers = None
        if self.log is not None:
            spark = candidates.sparkSession
            answers = AnswerLog(f"{checkpoint_dir(spark)}/answers-{self.log}")
            placed = candidates.repartition(self.tasks or shuffle_partitions(spark), "id")
            candidates = placed.sortWithinPartitions("id")
        elif self.tasks is not None:
            candidates = candidates.repartition(self.tasks)

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = None
            for rows in batches:
                if answers is None:
                    yield rows.assign(label=[int(function(r)) for r in rows.itertuples(index=False)])
                    continue
                if known is None:
                    part = TaskContext.get().partitionId()
                    known = answers.read(part)
                labels = []
                for start in range(0, len(rows), size):
                    some = rows.iloc[start : start + size]
                    new = [r for r in some.itertuples(index=False) if r.id not in known]
                    if new:
                        known |= answers.write(part, {r.id: int(function(r)) for r in new})
                    labels += [known[id_] for id_ in some["id"]]
                yield rows.assign(label=labels)

        fields = [*candidates.schema.fields, T.StructField("label", T.IntegerType())]
        return candidates.mapInPandas(call, T.StructType(fields))


@dataclass(frozen=True)
class AnswerLog:
    """Answers by id in files of a shared folder, one file per finished batch of a partition.

    A file is written under another name first and then renamed, so that a reader never sees half of
    one; the names do not collide, so that two runs of one task at once only add files."""

    folder: str

    def _place(self, part: int) -> tuple[fs.FileSystem, str]:
        files, path = fs.FileSystem.from_uri(self.folder if ":" in self.folder else f"file://{self.folder}")
        return files, f"{path}/{part}"

    def read(self, part: int) -> dict[str, int]:
        files, path = self._place(part)
        known: dict[str, int] = {}
        for info in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if info.base_name.endswith(".json"):
                with files.open_input_stream(info.path) as stream:
                    known |= json.loads(stream.read().decode())
        return known

    def write(self, part: int, found: dict[str, int]) -> dict[str, int]:
        files, path = self._place(part)
        files.create_dir(path, recursive=True)
        name = f"{path}/{uuid.uuid4().hex}"
        with files.open_output_stream(f"{name}.part") as stream:
            stream.write(json.dumps(found).encode())
        files.move(f"{name}.part", f"{name}.json")
        return found


@dataclass(frozen=True)
class GoldLabeler:
    """Answers from an ``(id, label)`` table; ids it lacks are missing from the answer."""

    gold: DataFrame

    def label(self, candidates: DataFrame) -> DataFrame:
        joined = self.gold.select("id", F.col("label").cast("int")).join(candidates, "id")
        return joined.select(*candidates.columns, "label")


def label_lookup(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold label of every row; a missing id is an error."""
    missing = F.raise_error(F.concat(F.lit("no gold label for id "), F.col("id"))).cast("int")
    return rows.join(gold.select("id", F.col("label").alias("_gold")), "id", "left").select(
        *rows.columns, F.coalesce(F.col("_gold").cast("int"), missing).alias("label")
    )


def fetch_by_ids(
    table: DataFrame, ids: DataFrame, at_most: int = UNKNOWN
) -> DataFrame:
    """The rows of the selected ids; ``at_most`` bounds the ids and decides on a broadcast.

    Ids beyond it are counted, and only rows that their Bloom filter lets pass are shuffled."""
    wanted = ids.select("id")
    if is_small(at_most):
        return table.join(F.broadcast(wanted), "id").select(*table.columns)
    wanted, found = _filtered(wanted)
    passed = table if found is None else table.where(found.may_hold(F.col("id")))
    return passed.join(wanted, "id").select(*table.columns)


def exclude_labeled(
    pool: DataFrame, ledger: DataFrame, at_most: int = UNKNOWN
) -> DataFrame:
    """Pool rows whose id has no direct label yet.

    Beyond a broadcast, rows outside the ledger's Bloom filter stay where they are, and only the
    others are shuffled to the exact join. A pool bucketed by id is not shuffled at all, and so not
    filtered either."""
    wanted = ledger.select("id")
    if is_small(at_most):
        return pool.join(F.broadcast(wanted), "id", "left_anti")
    if is_bucketed(pool):
        return pool.join(wanted, "id", "left_anti")
    wanted, found = _filtered(wanted)
    if found is None:
        return pool.join(wanted, "id", "left_anti")
    told = pool.withColumn("_told", found.may_hold(F.col("id")))
    free = told.where(~F.col("_told")).drop("_told")
    return free.unionByName(told.where("_told").drop("_told").join(wanted, "id", "left_anti"))


def _filtered(wanted: DataFrame) -> tuple[DataFrame, BloomFilter | None]:
    """The ids, written because they are read twice, and their filter."""
    held = written(wanted, "ids")
    return held, bloom_filter(held, held.count())


def append_labels(ledger: DataFrame | None, new: DataFrame) -> DataFrame:
    """Ledger plus new rows, written; an id may be labeled only once."""
    merged = cut_lineage(new if ledger is None else ledger.unionByName(new))
    repeated = merged.groupBy("id").count().where("count > 1")
    found = repeated.limit(1).collect()
    if found:
        raise ValueError(f"id {found[0]['id']} is already labeled")
    return merged
