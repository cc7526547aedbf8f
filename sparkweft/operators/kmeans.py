"""k-means with all restarts in one scan per step."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweft.operators.blocks import BLOCK_VALUES, check_dimension, matrix, row_slices

START_ROWS = 4_096  # rows the first centres are chosen from
TASKS_PER_CORE = 3  # each task of a step sends one sum per run and cluster


class KMeansGroups(NamedTuple):
    """Centres of the cheapest run, one row each, its cost, and the costs of all runs."""

    centres: np.ndarray
    cost: float
    costs: list[float]


def default_k(rows: int) -> int:
    """Number of clusters when none is given: a third of the rows, at least 1 and at most 10."""
    return max(1, min(rows // 3, 10))


def _squares(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    check_dimension(rows, centres)
    found = rows @ centres.T
    found *= -2
    found += (rows * rows).sum(1)[:, None]
    found += (centres * centres).sum(1)[None, :]
    return np.maximum(found, 0.0, out=found)


def spread_starts(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """At most ``k`` different rows, each drawn by its squared distance to those drawn before; fewer if no more differ."""
    chosen = [int(rng.integers(len(rows)))]
    far = ((rows - rows[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k and far.any():
        chosen.append(int(rng.choice(len(rows), p=far / far.sum())))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return rows[chosen]


def _step(points: DataFrame, tasks: int, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """One scan for all given runs: per run a row for each cluster, of its size, its cost and the sums of its components.

    The sums of the tasks are added up on the driver while all of them are at most ``BLOCK_VALUES`` numbers, otherwise by a
    shuffle.
    """
    runs = list(centres)
    stacked = np.concatenate([centres[run] for run in runs])
    k = len(stacked) // len(runs)

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(runs), k, stacked.shape[1] + 2))
        for batch in batches:
            rows = matrix(batch.column(0))
            for part in row_slices(len(rows), len(stacked)):
                some = rows[part]
                away = _squares(some, stacked).reshape(len(some), len(runs), k)
                near = away.argmin(2)
                least = np.take_along_axis(away, near[:, :, None], 2)[:, :, 0]
                for run in range(len(runs)):
                    held = np.zeros((k, len(some)))
                    held[near[:, run], np.arange(len(some))] = 1.0
                    sums[run, :, 0] += held.sum(1)
                    sums[run, :, 1] += held @ least[:, run]
                    sums[run, :, 2:] += held @ some
        used = np.argwhere(sums[:, :, 0] > 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([runs[run] for run, _ in used], pa.int32()),
                pa.array(used[:, 1].astype(np.int32)),
                pa.array([sums[run, cluster] for run, cluster in used], pa.list_(pa.float64())),
            ],
            ["run", "cluster", "sums"],
        )

    found = points.mapInArrow(partials, "run int, cluster int, sums array<double>")
    totals = {run: np.zeros((k, stacked.shape[1] + 2)) for run in runs}
    if tasks * len(runs) * k * (stacked.shape[1] + 2) <= BLOCK_VALUES:
        table = found.toArrow()
        for run, cluster, sums in zip(table["run"].to_pylist(), table["cluster"].to_pylist(), matrix(table["sums"])):
            totals[run][cluster] += sums
        return totals
    cells = found.select("run", "cluster", F.posexplode("sums").alias("place", "x"))
    table = cells.groupBy("run", "cluster", "place").agg(F.sum("x").alias("x")).toArrow()
    for run, cluster, place, x in zip(*(table.column(name).to_numpy() for name in ("run", "cluster", "place", "x"))):
        totals[run][cluster, place] = x
    return totals


def _converged(
    points: DataFrame, tasks: int, centres: dict[int, np.ndarray], max_iter: int | None, tol: float
) -> dict[int, float]:
    """Moves the centres of all runs until no centre of a run moves by more than ``tol`` (or ``max_iter`` steps are taken,
    if given), and gives the cost of each run."""
    moving = set(centres)
    for _ in count() if max_iter is None else range(max_iter):
        if not moving:
            break
        for run, totals in _step(points, tasks, {run: centres[run] for run in sorted(moving)}).items():
            held = totals[:, 0] > 0  # a centre without rows stays where it is
            moved = centres[run].copy()
            moved[held] = totals[held, 2:] / totals[held, :1]
            if np.sqrt(((moved - centres[run]) ** 2).sum(1)).max() <= tol:
                moving.discard(run)
            centres[run] = moved
    return {run: float(totals[:, 1].sum()) for run, totals in _step(points, tasks, centres).items()}


def fit_kmeans(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int | None = None,
    seed: int = 42,
    restarts: int = 10,
    max_iter: int | None = 300,
    tol: float = 1e-4,
) -> KMeansGroups:
    """Centres of the cheapest of ``restarts`` runs of k-means over all vectors that are not NULL.

    All runs advance together: a step is one scan, which sends the centres of every run that still moves to the tasks and
    sums rows by run and cluster there; a run drops out once none of its centres moves by more than ``tol``, or after
    ``max_iter`` steps; with ``max_iter`` None every run goes on until it has ended (Lloyd's steps end). Only centres
    reach the driver. If those of all runs are more than ``BLOCK_VALUES`` components, runs go in groups that fit.

    Each run starts from ``k`` rows drawn by their distance to each other from ``START_ROWS`` rows, those with the lowest
    hash of their key; fewer clusters result if fewer of these rows differ. The steps and costs cover all rows. No rows
    give no centres; vectors of unequal dimension are an error.
    """
    usable = vectors.where(F.col(vector).isNotNull())
    first = usable.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(vector)).alias("values")).head()
    if not first["rows"]:
        return KMeansGroups(np.zeros((0, 0)), 0.0, [])
    k = default_k(first["rows"]) if k is None else k
    width = max(1, first["values"])
    most = max(k, min(START_ROWS, BLOCK_VALUES // width))
    sample = usable.orderBy(F.xxhash64(key, F.lit(seed)), key).select(vector).limit(most).toArrow()
    rows = matrix(sample.column(0))
    starts = {run: spread_starts(rows, k, np.random.default_rng(seed + run)) for run in range(restarts)}
    together = max(1, BLOCK_VALUES // (k * width))
    tasks = TASKS_PER_CORE * vectors.sparkSession.sparkContext.defaultParallelism
    held = usable.select(vector).coalesce(tasks).persist()
    try:
        costs: dict[int, float] = {}
        for run in range(0, restarts, together):
            group = {r: starts[r] for r in range(run, min(run + together, restarts))}
            costs.update(_converged(held, tasks, group, max_iter, tol))
            starts.update(group)
    finally:
        held.unpersist()
    best = min(costs, key=lambda run: (costs[run], run))
    return KMeansGroups(starts[best], costs[best], [costs[run] for run in sorted(costs)])


def nearest_centres(vectors: DataFrame, centres: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key``, ``cluster_id`` of the nearest centre (of equally near ones the first) and the squared ``distance`` to it."""

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(1))
            away = [_squares(rows[part], centres) for part in row_slices(len(rows), len(centres))]
            near = np.concatenate([a.argmin(1) for a in away] or [np.zeros(0)]).astype(np.int32)
            least = np.concatenate([a.min(1) for a in away] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near), pa.array(least)], [key, "cluster_id", "distance"])

    usable = vectors.where(F.col(vector).isNotNull()).select(key, vector)
    schema = T.StructType([usable.schema[key], T.StructField("cluster_id", T.IntegerType()), T.StructField("distance", T.DoubleType())])
    if not len(centres):
        return usable.sparkSession.createDataFrame([], schema)
    return usable.mapInArrow(assigned, schema)


def kmeans(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int | None = None,
    seed: int = 42,
    restarts: int = 10,
    max_iter: int = 300,
    tol: float = 1e-4,
) -> DataFrame:
    """k-means, the cheapest of ``restarts`` runs (:func:`fit_kmeans`): ``key`` and ``cluster_id``."""
    found = fit_kmeans(vectors, key, vector, k, seed, restarts, max_iter, tol)
    return nearest_centres(vectors, found.centres, key, vector).drop("distance")
