"""Fits whose every step is one aggregation: principal axes, and k-means for many configurations at once.

Rows stay where they are. A task adds up what it holds (products of components, sums per
cluster), and only these few numbers are shuffled; their count depends on the parameters,
not on the rows. All steps are deterministic, so SQL can repeat them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from landshift.operators.ranking import hash_order

SWEEPS = 8  # of Jacobi rotations over all pairs of components


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        keys, v = np.array(batch.column("key").to_pylist(), dtype=object), _vectors(batch.column("v"))
        for key in set(keys):
            some = v[keys == key]
            numbers = np.concatenate([[len(some)], some.sum(0), (some.T @ some).ravel()])
            total[key] = total.get(key, 0) + numbers
    for key, numbers in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([key] * len(numbers)), pa.array(np.arange(len(numbers), dtype=np.int32)), pa.array(numbers)], ["key", "at", "value"])


def jacobi(matrix: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of a symmetric matrix after a fixed number of rotations, in the order of rows."""
    a, v = matrix.copy(), np.eye(len(matrix))
    for _ in range(sweeps):
        for p in range(len(a)):
            for q in range(p + 1, len(a)):
                if abs(a[p, q]) < 1e-150:
                    continue
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1 if theta >= 0 else -1) / (abs(theta) + np.sqrt(theta * theta + 1))
                c = 1 / np.sqrt(t * t + 1)
                s = t * c
                for m in (a.T, a, v):  # rows, then columns of the matrix, then the vectors
                    left, right = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = c * left - s * right, s * left + c * right
    return np.diag(a).copy(), v


def _axes(batches: Iterator[pa.RecordBatch], dims: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for numbers in batch.column("numbers").to_pylist():
            n, sums, products = numbers[0], np.array(numbers[1:dims + 1]), np.array(numbers[dims + 1:]).reshape(dims, dims)
            mean = sums / n
            values, vectors = jacobi(products / n - np.outer(mean, mean))
            best = np.argsort(-values, kind="stable")[:k]
            axes = vectors[:, best].T
            largest = axes[np.arange(len(axes)), np.abs(axes).argmax(1)]
            trace = values.sum()
            out.append((int(n), (axes * np.where(largest < 0, -1.0, 1.0)[:, None]).tolist(), float(values[best].sum() / trace) if trace > 0 else None))
        n, axes, explained = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(n, pa.int64()), pa.array(axes, pa.list_(pa.list_(pa.float64()))), pa.array(explained, pa.float64())],
            ["key", "n", "axes", "explained"])


def principal_axes(df: DataFrame, vector: str, dims: int, k: int, key: Column | None = None) -> DataFrame:
    """(key, n, axes, explained): the first k principal axes of the vectors of each key, and the share of variance they hold.

    One aggregation adds up all products of two components; the rotations then work on that
    dims x dims table. Of each axis, the largest component (the first of equals) is positive.
    Null vectors take no part. Keys are groups named by parameters, such as feature sets.
    """
    rows = df.where(F.col(vector).isNotNull()).select((F.lit("") if key is None else key).cast("string").alias("key"), F.col(vector).alias("v"))
    sums = rows.mapInArrow(_products, "key string, at int, value double").groupBy("key", "at").agg(F.sum("value").alias("value"))
    table = sums.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]).alias("numbers"))
    return table.mapInArrow(lambda it: _axes(it, dims, k), "key string, n bigint, axes array<array<double>>, explained double")


def project(vector: Column, axes: Column) -> Column:
    """Coordinates of a vector on each axis."""
    return F.transform(axes, lambda axis: F.aggregate(F.zip_with(vector, axis, lambda x, w: x * w), F.lit(0.0), lambda acc, x: acc + x))


# --- k-means --------------------------------------------------------------------
@dataclass
class Configuration:
    """One run of k-means over the rows of a space; `centroids` holds k x d numbers."""

    space: str
    k: int
    centroids: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    steps: int = 0
    settled: bool = False


def first_centres(df: DataFrame, space: str, key: Column, vector: str, most: int, seed: int) -> dict[str, np.ndarray]:
    """The first `most` vectors of each space in the hash order of their keys; few rows of a task leave it."""
    order = Window.partitionBy(space).orderBy(hash_order(key, seed), key)
    first = df.where(F.col(vector).isNotNull()).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    out: dict[str, list] = {}
    for r in first.select(F.col(space).alias("s"), "_n", F.col(vector).alias("v")).orderBy("s", "_n").collect():
        out.setdefault(r.s, []).append(r.v)
    return {s: np.array(v) for s, v in out.items()}


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each point, the first of equals; squares are added component by component."""
    d2 = np.zeros((len(centroids), len(points)))  # a row per centroid, so that long rows are worked on
    square = np.empty_like(d2)
    for column, at in zip(np.ascontiguousarray(points.T), centroids.T):
        np.subtract(column, at[:, None], out=square)
        d2 += np.multiply(square, square, out=square)
    return d2.argmin(0)


def _by_space(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    spaces, v = batch.column("space").dictionary_encode(), _vectors(batch.column("v"))
    number = spaces.indices.to_numpy(zero_copy_only=False)
    for i, space in enumerate(spaces.dictionary.to_pylist()):
        yield space, v[number == i]


def _cluster_sums(batches: Iterator[pa.RecordBatch], plan: dict[str, list[tuple[int, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for space, points in _by_space(batch):
            for number, centroids in plan.get(space, ()):
                own = nearest(points, centroids)
                columns = np.column_stack([np.ones(len(points)), (points * points).sum(1), points])
                sums = np.stack([np.bincount(own, c, len(centroids)) for c in columns.T], 1)
                for cluster in np.flatnonzero(sums[:, 0]):
                    at = (number, int(cluster))
                    total[at] = total.get(at, 0) + sums[cluster]
    rows = list(total.items())
    yield pa.RecordBatch.from_arrays(
        [pa.array([n for (n, _), _ in rows], pa.int32()), pa.array([c for (_, c), _ in rows], pa.int32()),
         pa.array([s.tolist() for _, s in rows], pa.list_(pa.float64()))], ["number", "cluster", "sums"])


def cluster_sums(points: DataFrame, runs: Sequence[Configuration]) -> list[np.ndarray]:
    """Per run and cluster: rows, sum of squares and component sums, from one aggregation over all rows for all runs."""
    plan: dict[str, list[tuple[int, np.ndarray]]] = {}
    for number, run in enumerate(runs):
        if len(run.centroids):
            plan.setdefault(run.space, []).append((number, run.centroids))
    width = max((run.centroids.shape[1] for run in runs if len(run.centroids)), default=0) + 2
    sums = points.select("space", "v").mapInArrow(lambda it: _cluster_sums(it, plan), "number int, cluster int, sums array<double>")
    found = sums.groupBy("number", "cluster").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums")).collect()
    out = [np.zeros((len(run.centroids), width)) for run in runs]
    for r in found:
        out[r.number][r.cluster] = r.sums
    return out


def lloyd(points: DataFrame, runs: Sequence[Configuration], steps: int) -> None:
    """Move the centroids of all runs, `steps` times at most; a run whose centroids stay is settled.

    `points` has a space and a vector `v` per row. A step is one job over the rows, whatever the
    number of runs; the driver sees k x d sums of each. An empty cluster keeps its centroid.
    """
    for _ in range(steps):
        active = [run for run in runs if len(run.centroids) and not run.settled]
        if not active:
            return
        for run, sums in zip(active, cluster_sums(points, active)):
            held = sums[:, 0] > 0
            after = run.centroids.copy()
            after[held] = sums[held, 2:] / sums[held, :1]
            run.settled, run.centroids, run.steps = bool((after == run.centroids).all()), after, run.steps + 1


def _silhouettes(batches: Iterator[pa.RecordBatch], plan: dict[str, list[tuple[int, np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list[float]] = {}
    for batch in batches:
        for space, points in _by_space(batch):
            square = (points * points).sum(1)
            for number, centroids, sums in plan.get(space, ()):
                own, n, row = nearest(points, centroids), sums[:, 0], np.arange(len(points))
                far = square[:, None] * n + sums[:, 1] - 2 * points @ sums[:, 2:].T
                a = far[row, own] / np.maximum(n[own] - 1, 1)
                other = np.where(n > 0, far / np.maximum(n, 1), np.inf)
                other[row, own] = np.inf
                b = other.min(1)
                top = np.maximum(a, b)
                s = np.where((n[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0)
                held = total.setdefault(number, [0.0, 0.0])
                held[0] += len(points)
                held[1] += float(s.sum())
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([t[0] for t in total.values()], pa.float64()), pa.array([t[1] for t in total.values()], pa.float64())],
        ["number", "n", "s"])


def silhouettes(points: DataFrame, runs: Sequence[Configuration]) -> list[tuple[int, int, float | None]]:
    """(rows, clusters held, silhouette) of each run over all rows, with squared distances; None with fewer than two clusters.

    A cluster's size, sum and sum of squares give a row's mean squared distance to all its
    members, so two aggregations serve all rows of all runs.
    """
    sums = cluster_sums(points, runs)
    plan: dict[str, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for number, (run, s) in enumerate(zip(runs, sums)):
        if (s[:, 0] > 0).sum() > 1:
            plan.setdefault(run.space, []).append((number, run.centroids, s))
    found = points.select("space", "v").mapInArrow(lambda it: _silhouettes(it, plan), "number int, n double, s double").groupBy("number").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    score = {r.number: r.s / r.n for r in found}
    return [(int(s[:, 0].sum()), int((s[:, 0] > 0).sum()), score.get(i)) for i, s in enumerate(sums)]
