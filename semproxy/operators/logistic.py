"""One optimiser for many logistic models at once.

The objective of a model is the summed loss of its rows plus half of ``l2`` times the squared norm of
its weights; the intercept carries no penalty. Models whose rows fit one task are fitted there, all of
them in one job. The rows of larger ones are written once, and each pass is one job for all models
that are not done: tasks form the partial sums of every model they hold rows of, by matrix products,
and the sums are added in a tree, so the driver receives one row per model. The number of jobs depends
neither on the number of models nor on the number of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semproxy.session import FIT_BYTES, drop_written, written

# A model's curvature is summed while it takes at most so many bytes; wider models go without.
CURVATURE_BYTES = 4 * 1024 * 1024

# Partial sums one task adds up.
FAN_IN = 64

# Gradients remembered by the optimiser without curvature.
MEMORY = 10

HALVINGS = 30


@dataclass(frozen=True)
class Settings:
    l2: float
    max_iter: int
    tol: float
    standardize: bool


@dataclass
class Sums:
    """Loss, gradient and, if asked for, curvature of some rows at a point (intercept first)."""

    loss: float
    gradient: np.ndarray
    curvature: np.ndarray | None = None

    @staticmethod
    def of(x: np.ndarray, y: np.ndarray, point: np.ndarray, curved: bool) -> Sums:
        z = x @ point[1:] + point[0]
        e = np.exp(-np.abs(z))
        p = np.where(z >= 0, 1, e) / (1 + e)
        loss = float(np.sum(np.maximum(z, 0) - y * z + np.log1p(e)))
        slope = p - y
        gradient = np.concatenate([[slope.sum()], slope @ x])
        if not curved:
            return Sums(loss, gradient)
        weight = p * (1 - p)
        weighted = x * weight[:, None]
        curvature = np.empty((len(point), len(point)))
        curvature[0, 0] = weight.sum()
        curvature[0, 1:] = curvature[1:, 0] = weighted.sum(axis=0)
        curvature[1:, 1:] = x.T @ weighted
        return Sums(loss, gradient, curvature)

    def packed(self) -> list[float]:
        parts = [np.array([self.loss]), self.gradient]
        if self.curvature is not None:
            parts.append(self.curvature.ravel())
        return np.concatenate(parts)

    @staticmethod
    def unpacked(values: np.ndarray, size: int) -> Sums:
        curvature = values[1 + size :]
        return Sums(float(values[0]), values[1 : 1 + size], curvature.reshape(size, size) if len(curvature) else None)


def is_curved(width: int) -> bool:
    return (width + 1) ** 2 * 8 <= CURVATURE_BYTES


@dataclass
class Optimiser:
    """Newton steps where the sums have curvature, else limited-memory quasi-Newton steps; a step is
    halved until the objective falls enough. Ask for :attr:`trial`, then hand in its sums."""

    rows: int
    penalty: np.ndarray
    settings: Settings
    trial: np.ndarray
    done: bool = False
    point: np.ndarray | None = None
    value: float = 0.0
    first: float = 0.0
    gradient: np.ndarray | None = None
    direction: np.ndarray | None = None
    length: float = 1.0
    halved: int = 0
    passes: int = 0
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def take(self, sums: Sums) -> None:
        self.passes += 1
        value = (sums.loss + 0.5 * float(self.penalty @ self.trial**2)) / self.rows
        gradient = (sums.gradient + self.penalty * self.trial) / self.rows
        if self.point is not None:
            slope = float(self.gradient @ self.direction)
            if not value <= self.value + 1e-4 * self.length * slope:
                self.halved += 1
                if self.halved > HALVINGS or self.passes >= 2 * self.settings.max_iter:
                    self.done = True
                    return
                self.length /= 2
                self.trial = self.point + self.length * self.direction
                return
            moved, turned = self.trial - self.point, gradient - self.gradient
            if float(moved @ turned) > 0:
                self.pairs = [*self.pairs, (moved, turned)][-MEMORY:]
        else:
            self.first = value
        fallen = self.value - value if self.point is not None else np.inf
        self.point, self.value, self.gradient = self.trial, value, gradient
        small = float(np.linalg.norm(gradient)) <= max(self.settings.tol * abs(value), 1e-10)
        if fallen <= self.settings.tol * abs(self.first) or small or self.passes >= self.settings.max_iter:
            self.done = True
            return
        self.direction = self.downhill(gradient, sums.curvature)
        self.length, self.halved = 1.0, 0
        self.trial = self.point + self.direction

    def downhill(self, gradient: np.ndarray, curvature: np.ndarray | None) -> np.ndarray:
        if curvature is not None:
            curvature = (curvature + np.diag(self.penalty)) / self.rows
            # Rows that do not span all directions leave it singular.
            ridge = 1e-10 * max(float(np.trace(curvature)) / len(curvature), 1e-12)
            try:
                return -np.linalg.solve(curvature + ridge * np.eye(len(curvature)), gradient)
            except np.linalg.LinAlgError:
                return -gradient
        found = gradient.copy()
        shares = []
        for moved, turned in reversed(self.pairs):
            share = float(moved @ found) / float(moved @ turned)
            shares.append(share)
            found -= share * turned
        if self.pairs:
            moved, turned = self.pairs[-1]
            found *= float(moved @ turned) / float(turned @ turned)
        for (moved, turned), share in zip(self.pairs, reversed(shares)):
            found += (share - float(turned @ found) / float(moved @ turned)) * moved
        return -found


def penalties(settings: Settings, n: int, sums: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """The penalty per position; standardised settings weigh it by the variance of the column."""
    scale = np.ones(len(sums))
    if settings.standardize and n > 1:
        scale = np.maximum(squares - sums**2 / n, 0) / (n - 1)
    return np.concatenate([[0.0], settings.l2 * scale])


def fit_arrays(x: np.ndarray, y: np.ndarray, settings: Settings) -> np.ndarray:
    """The fitted point of rows in memory. Fewer rows than columns are first turned to the
    directions they span, in which the weights lie anyway."""
    n, width = x.shape
    penalty = penalties(settings, n, x.sum(axis=0), (x**2).sum(axis=0))
    turn = None
    if n < width and not (settings.standardize and settings.l2):
        left, sizes, turn = np.linalg.svd(x, full_matrices=False)
        x, penalty = left * sizes, penalty[: len(sizes) + 1]
    optimiser = Optimiser(n, penalty, settings, np.zeros(x.shape[1] + 1))
    curved = is_curved(x.shape[1])
    while not optimiser.done:
        optimiser.take(Sums.of(x, y, optimiser.trial, curved))
    point = optimiser.point
    return point if turn is None else np.concatenate([point[:1], point[1:] @ turn])


def matrix(embeddings: pa.Array, width: int) -> np.ndarray:
    return embeddings.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def keyed_runs(keys: pa.Array) -> Iterator[tuple[str, int, int]]:
    """``(key, start, end)`` of the runs of equal keys in sorted order."""
    names = keys.to_pylist()
    start = 0
    for end in range(1, len(names) + 1):
        if end == len(names) or names[end] != names[start]:
            yield names[start], start, end
            start = end


def fit_small(rows: DataFrame, width: int, settings: Settings) -> dict[str, np.ndarray]:
    """Points by key of models whose rows, ``(key, id, embedding, label)``, each fit one task."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, xs, ys = None, [], []

        def fitted() -> pa.RecordBatch:
            point = fit_arrays(np.concatenate(xs), np.concatenate(ys), settings)
            return pa.RecordBatch.from_arrays(
                [pa.array([now]), pa.array([point.tolist()], pa.list_(pa.float64()))], names=["key", "point"]
            )

        for batch in batches:
            x, y = matrix(batch.column(1), width), batch.column(2).to_numpy(zero_copy_only=False)
            for key, start, end in keyed_runs(batch.column(0)):
                if key != now:
                    if xs:
                        yield fitted()
                    now, xs, ys = key, [], []
                xs.append(x[start:end])
                ys.append(y[start:end].astype(np.float64))
        if xs:
            yield fitted()

    placed = rows.repartition("key").sortWithinPartitions("key", "id").select("key", "embedding", "label")
    found = placed.mapInArrow(fit, "key string, point array<double>").collect()
    return {row["key"]: np.array(row["point"]) for row in found}


def added(partials: DataFrame, parts: int) -> DataFrame:
    """``(key, part, sums)`` summed per key, at most :data:`FAN_IN` rows a task, level by level."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [
            (part, values.values.to_numpy())
            for batch in batches
            for part, values in zip(batch.column(1).to_pylist(), batch.column(2))
        ]
        rows.sort(key=lambda row: row[0])  # one order of additions, whatever the shuffle
        total = np.sum([values for _, values in rows], axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))],
            names=["key", "part", "sums"],
        )

    while parts > 1:
        partials = partials.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("key", "part").applyInArrow(
            add, "key string, part long, sums array<double>"
        )
        parts = -(-parts // FAN_IN)
    return partials


def summed(rows: DataFrame, work, width: int) -> dict[str, np.ndarray]:
    """``work(key, x, y)`` of the runs of ``(key, embedding, label)``, added up per key."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            x, y = matrix(batch.column(1), width), batch.column(2).to_numpy(zero_copy_only=False)
            for key, start, end in keyed_runs(batch.column(0)):
                values = work(key, x[start:end], y[start:end].astype(np.float64))
                if values is not None:
                    totals[key] = totals[key] + values if key in totals else values
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.string()), pa.array([v.tolist() for v in totals.values()], pa.list_(pa.float64()))],
            names=["key", "sums"],
        )

    parts = rows.rdd.getNumPartitions()
    partials = rows.mapInArrow(partial, "key string, sums array<double>").withColumn(
        "part", F.spark_partition_id().cast("long")
    )
    found = added(partials.select("key", "part", "sums"), max(parts, 2)).collect()
    totals: dict[str, np.ndarray] = {}
    for row in sorted(found, key=lambda r: r["part"]):
        values = np.array(row["sums"])
        totals[row["key"]] = totals[row["key"]] + values if row["key"] in totals else values
    return totals


def fit_large(rows: DataFrame, counts: dict[str, int], width: int, settings: Settings) -> dict[str, np.ndarray]:
    """Points by key by passes over the written rows, each of them for all models not yet done."""
    parts = 1 + sum(counts.values()) * width * 8 // FIT_BYTES
    placed = rows.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")
    held = written(placed.select("key", "embedding", "label"), "fit")
    curved = is_curved(width)
    spreads: dict[str, np.ndarray] = {}
    if settings.standardize and settings.l2:
        spreads = summed(held, lambda key, x, y: np.concatenate([x.sum(axis=0), (x**2).sum(axis=0)]), width)
    none = np.zeros(2 * width)
    models = {
        key: Optimiser(n, penalties(settings, n, *np.split(spreads.get(key, none), 2)), settings, np.zeros(width + 1))
        if spreads
        else Optimiser(n, np.concatenate([[0.0], np.full(width, settings.l2)]), settings, np.zeros(width + 1))
        for key, n in counts.items()
    }
    while trials := {key: model.trial for key, model in models.items() if not model.done}:
        shared = held.sparkSession.sparkContext.broadcast(trials)

        def work(key: str, x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
            trial = shared.value.get(key)
            return None if trial is None else Sums.of(x, y, trial, curved).packed()

        for key, values in summed(held, work, width).items():
            models[key].take(Sums.unpacked(values, width + 1))
        shared.destroy()
    drop_written(held)
    return {key: model.point for key, model in models.items()}


def fit_models(rows: DataFrame, counts: dict[str, int], width: int, settings: Settings) -> dict[str, np.ndarray]:
    """The fitted point (intercept, then weights) of every key of ``rows(key, id, embedding,
    label)``; ``counts`` are the rows per key. Only where a model's rows are worked on depends on
    their number."""
    bound = FIT_BYTES // (8 * width)
    small = [key for key, n in counts.items() if n <= bound]
    large = {key: n for key, n in counts.items() if n > bound}
    points: dict[str, np.ndarray] = {}
    if small:
        points |= fit_small(rows if not large else rows.where(~F.col("key").isin(list(large))), width, settings)
    if large:
        points |= fit_large(rows.where(F.col("key").isin(list(large))), large, width, settings)
    return points
