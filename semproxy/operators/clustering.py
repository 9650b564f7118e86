"""k-means over embeddings, globally or inside every shard, and nearest-centroid assignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semproxy.config import ClusterOptions
from semproxy.functions.scoring import seeded_key
from semproxy.operators.checks import require_valid_candidates
from semproxy.operators.topk import place_of_hex, top_k_per_group
from semproxy.session import ID_BYTES, cut_lineage, small

# Centroids of one pass are shipped to every task; more shards than fit go through further passes.
CENTROID_BYTES = 256 * 1024 * 1024

# Bytes of a chunk's distance matrix.
CHUNK_BYTES = 8 * 1024 * 1024

# Centres by shard: their numbers and one matrix row each.
Centers = dict[Any, tuple[list[int], np.ndarray]]


class Partition(Protocol):
    """Clusters of a pool: ``assign`` adds the ``keys`` columns to rows of the pool."""

    keys: tuple[str, ...]
    clusters: int

    def assign(self, df: DataFrame) -> DataFrame: ...


def _matrix(embeddings: pa.Array, width: int) -> np.ndarray:
    """Embeddings as one row each; NULLs and other widths are an error."""
    values = embeddings.flatten()
    widths = pc.min_max(pc.list_value_length(embeddings)).as_py()
    if embeddings.null_count or values.null_count or {widths["min"], widths["max"]} - {width, None}:
        raise ValueError(f"embeddings must hold {width} values and no NULL")
    return values.to_numpy(zero_copy_only=False).reshape(len(embeddings), width)


def _chunks(rows: np.ndarray, centers: np.ndarray) -> list[np.ndarray]:
    """Row numbers in chunks whose distances to all centres stay within :data:`CHUNK_BYTES`."""
    size = max(1, CHUNK_BYTES // (8 * max(1, len(centers))))
    return [rows[start : start + size] for start in range(0, len(rows), size)]


def _nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of and squared distance to the nearest centre; ties go to the first centre."""
    rough = (points**2).sum(1)[:, None] - 2 * points @ centers.T + (centers**2).sum(1)[None, :]
    best = rough.min(1)
    close = rough <= (best + 1e-9 * (1 + np.abs(best)))[:, None]
    chosen = close.argmax(1)
    tied = np.flatnonzero(close.sum(1) > 1)
    if len(tied):
        # Many copies of one row may tie at once: measure them together, centre by centre.
        rivals = np.flatnonzero(close[tied].any(0))
        exact = np.full((len(tied), len(rivals)), np.inf)
        for column, rival in enumerate(rivals):
            mine = np.flatnonzero(close[tied, rival])
            exact[mine, column] = ((points[tied[mine]] - centers[rival]) ** 2).sum(1)
        chosen[tied] = rivals[exact.argmin(1)]
    return chosen, ((points - centers[chosen]) ** 2).sum(1)


def nearest_centroid(
    embedding: Column, shard: Column, centers: Centers
) -> Column:
    """``struct(cluster, distance)`` against the centres of the row's shard."""
    width = next(iter(centers.values()))[1].shape[1]

    @F.arrow_udf("struct<cluster:int,distance:double>")
    def assign(shards: pa.Array, embeddings: pa.Array) -> pa.Array:
        rows = len(embeddings)
        cluster = np.zeros(rows, np.int32)
        distance = np.zeros(rows)
        known = np.zeros(rows, bool)
        points = _matrix(embeddings, width)
        owner = shards.to_numpy(zero_copy_only=False)
        for value in set(owner.tolist()) & centers.keys():
            names, matrix = centers[value]
            mine = np.flatnonzero(owner == value)
            for part in _chunks(mine, matrix):
                chosen, distance[part] = _nearest(points[part].astype(np.float64), matrix)
                cluster[part] = np.asarray(names, np.int32)[chosen]
            known[mine] = True
        return pa.StructArray.from_arrays(
            [pa.array(cluster), pa.array(distance)], ["cluster", "distance"], mask=pa.array(~known)
        )

    return assign(shard, embedding)


@dataclass(frozen=True)
class CentroidPartition:
    """Clusters given by centres, per shard; a plain run has the one shard 0."""

    centers: Centers
    shard_col: str | None = None

    @property
    def keys(self) -> tuple[str, ...]:
        return ("cluster",) if self.shard_col is None else (self.shard_col, "cluster")

    @property
    def clusters(self) -> int:
        return sum(len(names) for names, _ in self.centers.values())

    def assign(self, df: DataFrame) -> DataFrame:
        """Rows with ``cluster`` and ``distance``; a narrow pass, nothing is joined.

        Both columns are never NULL. Otherwise a later join on ``cluster`` would push a null
        filter below the function and evaluate it twice.
        """
        shard = F.lit(0) if self.shard_col is None else F.col(self.shard_col)
        parts = []
        for centers in _batches(self.centers):
            nearest = nearest_centroid(F.col("embedding"), shard, centers)
            rows = df if self.shard_col is None else df.where(shard.isin(list(centers)))
            parts.append(
                rows.withColumn("_nearest", nearest)
                .withColumn("cluster", F.coalesce(F.col("_nearest.cluster"), F.lit(-1)))
                .withColumn("distance", F.coalesce(F.col("_nearest.distance"), F.lit(0.0)))
                .drop("_nearest")
            )
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result

    def centroids(self, spark: SparkSession) -> DataFrame:
        rows = [
            (shard, int(name), [float(x) for x in row])
            for shard, (names, matrix) in self.centers.items()
            for name, row in zip(names, matrix)
        ]
        kind = "string" if any(isinstance(shard, str) for shard in self.centers) else "long"
        return spark.createDataFrame(rows, f"shard {kind}, cluster int, center array<double>")


@dataclass(frozen=True)
class AssignmentTable:
    """Clusters given as an ``(id, cluster)`` table; rows without an assignment are left out."""

    assignments: DataFrame
    keys: tuple[str, ...] = ("cluster",)
    clusters: int = 1 << 62

    def assign(self, df: DataFrame) -> DataFrame:
        return df.join(self.assignments.select("id", *self.keys), "id")


def _batches(centers: dict) -> list[dict]:
    batches: list[dict] = [{}]
    used = 0
    for shard, (names, matrix) in centers.items():
        if batches[-1] and used + matrix.nbytes > CENTROID_BYTES:
            batches.append({})
            used = 0
        batches[-1][shard] = (names, matrix)
        used += matrix.nbytes
    return batches


def kmeans_partition(
    pool: DataFrame, options: ClusterOptions, seed: int
) -> CentroidPartition | None:
    """Seeded k-means over the whole pool, with k clamped to its rows; None for an empty pool."""
    whole = pool.select("id", F.lit(0).alias("_whole"), "embedding")
    partition = sharded_kmeans(whole, "_whole", (0,), options, seed)
    return None if partition is None else CentroidPartition(partition.centers)


def sharded_kmeans(
    pool: DataFrame, shard_col: str, shards: tuple, options: ClusterOptions, seed: int
) -> CentroidPartition | None:
    """k-means inside every shard at once: Lloyd passes keyed by shard and cluster.

    Only per-task sums are shuffled, so a shard of any size spreads over all tasks. Start centres
    are the distinct vectors with the smallest seeded keys of each shard, whatever the partitions
    are, so copies of a row cost no centre, or are drawn far from each other (``options.start``). A centre that loses its rows moves to the row that lies
    furthest from its own centre. Rows are cached as they are read; what does not fit in memory
    spills to the executors' disks and is computed again if an executor is lost.
    """
    rows = pool.select("id", shard_col, "embedding").persist()
    try:
        counts = require_valid_candidates(rows, unique_ids=False)
        return _lloyd(rows, shard_col, shards, options, seed, counts["max_width"] or 1)
    finally:
        rows.unpersist()


def _per_center(rows: DataFrame, shard_col: str, centers: Centers, furthest: bool) -> DataFrame:
    """``(shard, cluster, n_rows, distance, total)`` per task, shards by their position.

    ``total`` is the vector sum of a centre's rows or, for ``furthest``, the row furthest away."""
    width = next(iter(centers.values()))[1].shape[1]
    position = {shard: number for number, shard in enumerate(centers)}

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[Any, np.ndarray] = {}
        counts: dict[Any, np.ndarray] = {}
        distances: dict[Any, np.ndarray] = {}
        for batch in batches:
            owner = batch.column(0).to_numpy(zero_copy_only=False)
            points = _matrix(batch.column(1), width)
            for shard in set(owner.tolist()) & centers.keys():
                matrix = centers[shard][1]
                if shard not in totals:
                    totals[shard] = np.zeros(matrix.shape)
                    counts[shard] = np.zeros(len(matrix), np.int64)
                    distances[shard] = np.full(len(matrix), -1.0)
                for part in _chunks(np.flatnonzero(owner == shard), matrix):
                    rows_here = points[part].astype(np.float64)
                    chosen, far = _nearest(rows_here, matrix)
                    counts[shard] += np.bincount(chosen, minlength=len(matrix))
                    if furthest:
                        # The last of equal positions wins: the furthest row of each centre.
                        order = np.argsort(far, kind="stable")
                        last = np.full(len(matrix), -1)
                        last[chosen[order]] = order
                        better = np.flatnonzero(last >= 0)
                        better = better[far[last[better]] > distances[shard][better]]
                        totals[shard][better] = rows_here[last[better]]
                        distances[shard][better] = far[last[better]]
                    else:
                        member = np.zeros((len(matrix), len(part)))
                        member[chosen, np.arange(len(part))] = 1.0
                        totals[shard] += member @ rows_here
        for shard, rows_per_center in counts.items():
            seen = np.flatnonzero(rows_per_center)
            columns = [
                pa.array(np.full(len(seen), position[shard]), pa.int32()),
                pa.array(np.asarray(centers[shard][0])[seen], pa.int32()),
                pa.array(rows_per_center[seen], pa.int64()),
                pa.array(distances[shard][seen], pa.float64()),
                pa.array(list(totals[shard][seen]), pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, names=["shard", "cluster", "n_rows", "distance", "total"]
            )

    return rows.select(shard_col, "embedding").mapInArrow(
        add_up, "shard int, cluster int, n_rows long, distance double, total array<double>"
    )


def cluster_sums(rows: DataFrame, shard_col: str, centers: Centers) -> DataFrame:
    """``(shard, cluster, n_rows, total)``: rows per nearest centre and their vector sum, for shards
    by their position in ``centers``.

    A task adds up all its rows and hands on one row per cluster.
    """
    per_task = _per_center(rows, shard_col, centers, False)
    return per_task.groupBy("shard", "cluster").agg(
        F.sum("n_rows").alias("n_rows"),
        vector_to_array(Summarizer.sum(array_to_vector(F.col("total")))).alias("total"),
    )


def _reseeded(rows: DataFrame, shard_col: str, centers: Centers, empty: dict[Any, list[int]]) -> None:
    """Move the ``empty`` centres of each shard to the rows furthest from their centres."""
    asked = {shard: centers[shard] for shard in empty}
    per_task = _per_center(rows, shard_col, asked, True)
    found = per_task.groupBy("shard", "cluster").agg(
        F.max(F.struct("distance", "total")).alias("far")
    )
    names = list(asked)
    far: dict[Any, list] = {}
    for row in found.collect():
        far.setdefault(names[row["shard"]], []).append((row["far"]["distance"], row["far"]["total"]))
    for shard, numbers in empty.items():
        ordered = sorted(far.get(shard, []), reverse=True)
        for number, (distance, row) in zip(numbers, ordered):
            if distance > 0:
                centers[shard][1][number] = row


def _start(
    pool: DataFrame, shard_col: str, shards: tuple, options: ClusterOptions, seed: int, width: int
) -> Centers:
    """The first distinct vectors of each shard in seeded order, collected in batches of shards.

    The first rows in that order, twice as many as centres are asked for, hold them unless copies
    abound; only shards where they do not are searched by an aggregate over their vectors."""
    order = [F.col("_key"), F.col("id")]
    keyed = pool.select("id", shard_col, seeded_key(F.col("id"), seed).alias("_key"))
    rows = 2 * options.cluster_count
    heads = top_k_per_group(keyed, shard_col, order, dict.fromkeys(shards, rows), place_of_hex(F.col("_key")))
    centers, seen = _distinct(pool, heads, shard_col, shards, options, rows, width)
    short = tuple(s for s in shards if seen.get(s, 0) == rows and len(centers[s][0]) < options.cluster_count)
    if short:
        own = pool.where(F.col(shard_col).isin(list(short)))
        vectors = (
            own.groupBy(shard_col, F.xxhash64("embedding").alias("_vector"))
            .agg(F.min(F.struct(seeded_key(F.col("id"), seed).alias("_key"), "id")).alias("_head"))
            .select("_head.id", shard_col, "_head._key")
        )
        quotas = dict.fromkeys(short, options.cluster_count)
        heads = top_k_per_group(vectors, shard_col, order, quotas, place_of_hex(F.col("_key")))
        centers |= _distinct(own, heads, shard_col, short, options, options.cluster_count, width)[0]
    return {shard: centers[shard] for shard in shards if shard in centers}


def _distinct(
    pool: DataFrame, heads: DataFrame, shard_col: str, shards: tuple, options: ClusterOptions, rows: int, width: int
) -> tuple[Centers, dict[Any, int]]:
    """The first distinct vectors among the ``heads`` of each shard, and how many heads it has."""
    bound = rows * len(shards)
    found = pool.join(small(heads.select("id", "_key"), bound, 2 * ID_BYTES), "id").select(shard_col, "_key", "id", "embedding")
    step = max(1, CENTROID_BYTES // ((64 + 8 * width) * rows))
    if len(shards) > step:
        found = cut_lineage(found)
    centers: Centers = {}
    seen: dict[Any, int] = {}
    for number in range(0, len(shards), step):
        batch = shards[number : number + step]
        taken = found if len(shards) <= step else found.where(F.col(shard_col).isin(list(batch)))
        by_shard: dict[Any, list] = {}
        for row in sorted(taken.collect(), key=lambda row: (row["_key"], row["id"])):
            by_shard.setdefault(row[shard_col], []).append(row["embedding"])
        for shard in batch:
            if shard in by_shard:
                seen[shard] = len(by_shard[shard])
                distinct = dict.fromkeys(map(tuple, by_shard[shard]))
                matrix = np.asarray(list(distinct)[: options.cluster_count], np.float64)
                centers[shard] = (list(range(len(matrix))), matrix)
    return centers, seen


def _oversampled(
    pool: DataFrame, shard_col: str, shards: tuple, options: ClusterOptions, seed: int, width: int
) -> Centers:
    """Start centres spread like the rows: each round adds rows drawn with probabilities in
    proportion to their distance from those there are, as many as there are to be centres; they are
    weighed by the rows nearest to them and reduced to the wanted number on the driver.

    A round is one pass. Its draw is a race, the smallest of -ln(u) / distance, with u from the id and the
    seed, so it does not depend on partitions; tasks pass on only their first rows, without vectors."""
    centers = _start(pool, shard_col, shards, replace(options, cluster_count=1), seed, width)
    if not centers:
        return centers
    bound = options.cluster_count * len(shards)
    for number in range(options.start_rounds):
        drawn = F.conv(F.substring(seeded_key(F.col("id"), seed + 1 + number), 1, 13), 16, 10).cast("double")
        race = -F.log((drawn + 1) / F.lit(2.0**52 + 2)) / F.col("distance")
        rows = CentroidPartition(centers, shard_col).assign(pool).where("distance > 0")
        rows = rows.select("id", shard_col, race.alias("_race"))
        place = F.row_number().over(Window.partitionBy(shard_col).orderBy("_race", "id"))
        first = cut_lineage(rows.withColumn("_place", place).where(F.col("_place") <= options.cluster_count))
        found = pool.join(small(first.select("id", "_place"), bound), "id").select(shard_col, "_place", "embedding")
        added: dict[Any, list] = {}
        for row in sorted(found.collect(), key=lambda row: row["_place"]):
            added.setdefault(row[shard_col], []).append(row["embedding"])
        for shard, vectors in added.items():
            matrix = np.unique(np.concatenate([centers[shard][1], np.asarray(vectors, np.float64)]), axis=0)
            centers[shard] = (list(range(len(matrix))), matrix)
        if not added:
            break
    weights = {shard: np.zeros(len(names)) for shard, (names, _) in centers.items()}
    for batch in _batches(centers):
        names = list(batch)
        for row in cluster_sums(pool, shard_col, batch).select("shard", "cluster", "n_rows").collect():
            weights[names[row["shard"]]][row["cluster"]] = row["n_rows"]
    rng = np.random.default_rng(seed)
    found = {shard: _reduced(matrix, weights[shard], options.cluster_count, rng) for shard, (_, matrix) in centers.items()}
    return {shard: (list(range(len(matrix))), matrix) for shard, matrix in found.items()}


def _reduced(points: np.ndarray, weights: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """``count`` weighted means of the ``points``."""
    if len(points) <= count:
        return points
    centers = points[[int(weights.argmax())]]
    far = ((points - centers[0]) ** 2).sum(1)
    while len(centers) < count and (odds := weights * far).sum() > 0:
        chosen = points[rng.choice(len(points), p=odds / odds.sum())]
        centers = np.vstack([centers, chosen])
        far = np.minimum(far, ((points - chosen) ** 2).sum(1))
    for _ in range(10):
        nearest, _ = _nearest(points, centers)
        for number in range(len(centers)):
            mine = nearest == number
            if weights[mine].sum() > 0:
                centers[number] = np.average(points[mine], axis=0, weights=weights[mine])
    return centers


def _lloyd(
    pool: DataFrame, shard_col: str, shards: tuple, options: ClusterOptions, seed: int, width: int
) -> CentroidPartition | None:
    """Centres stay on the driver and go to the tasks in batches of :data:`CENTROID_BYTES`."""
    start = _oversampled if options.start == "oversampled" else _start
    centers = start(pool, shard_col, shards, options, seed, width)
    if not centers:
        return None
    spread = max(float(np.ptp(matrix, axis=0).max()) for _, matrix in centers.values())
    for step in range(options.max_iterations):
        shift = 0.0
        empty: dict[Any, list[int]] = {}
        for batch in _batches(centers):
            names = list(batch)
            seen = {shard: np.zeros(len(batch[shard][1]), bool) for shard in names}
            for row in cluster_sums(pool, shard_col, batch).collect():
                shard, number = names[row["shard"]], row["cluster"]
                center = np.asarray(row["total"]) / row["n_rows"]
                shift = max(shift, float(np.abs(center - centers[shard][1][number]).max()))
                centers[shard][1][number] = center
                seen[shard][number] = True
            for shard in names:
                if not seen[shard].all():
                    empty[shard] = np.flatnonzero(~seen[shard]).tolist()
        if empty and step + 1 < options.max_iterations:
            _reseeded(pool, shard_col, centers, empty)
        elif shift <= options.tolerance * spread:
            break
    return CentroidPartition(centers, shard_col)


def cluster_representatives(assigned: DataFrame, keys: tuple[str, ...] = ("cluster",)) -> DataFrame:
    """The row nearest its centre in every cluster, ties to the smaller id."""
    nearest = F.min_by("id", F.struct("distance", "id"))
    return assigned.groupBy(*keys).agg(nearest.alias("id"))
