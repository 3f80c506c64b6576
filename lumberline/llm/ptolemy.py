"""Centroid clustering in exact integers, pruned by Ptolemy's inequality over fixed pivots.

For a vector x, a centroid c and two pivots p, q:
``|x - c| * |p - q| >= ||x - p| * |c - q| - |x - q| * |c - p||``. Distances of all vectors
to the pivots are computed once and stored. In each round the centroid with the least
lower bound is measured exactly; of the others only those whose bound, rounded down,
does not exceed that distance, rounded up, are measured too. So the result is the same
as that of measuring all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.llm.store import stored
from lumberline.llm.words import lean

# Beyond this a squared distance of 64 components may leave 64 bits.
LARGEST = 1 << 27
SLACK = 1e-9  # relative; far above the rounding of the few operations of a bound
ROWS = 4096  # rows measured at a time


def quantized(vectors: DataFrame, dim: int = 64, scale: int = 1024) -> DataFrame:
    """``vec_id, point``: the rows with exactly ``dim`` components, none NULL or not finite, times ``scale``, rounded down."""
    x = F.col("embedding")
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(scale)))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    kept = kept.filter((F.size(x) == dim) & finite)
    fits = F.forall(x, lambda v: F.abs(v) * scale < F.lit(float(LARGEST)))
    problem = F.raise_error(F.lit(f"a component leaves {LARGEST / scale:g}, so squared distances may not fit 64 bits"))
    return kept.select("vec_id", F.when(fits, whole).otherwise(problem.cast("array<bigint>")).alias("point"))


def seeds(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` points whose ``seed:vec_id`` has the smallest SHA-256, in that order; rows with a NULL id come last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = points.select("point", order.alias("h")).orderBy(F.asc_nulls_last("h"), "point").limit(k)
    rows = [r["point"] for r in first.collect()]  # k rows
    return np.array(rows, np.int64)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a to all rows of b (of few rows)."""
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)


class Pivots:
    """Fixed points and all pairs of different ones."""

    def __init__(self, points: np.ndarray):
        self.points = np.unique(points, axis=0)
        between = np.sqrt(squares(self.points, self.points).astype(float))
        self.pairs = [(i, j, between[i, j]) for i, j in combinations(range(len(self.points)), 2)]

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(squares(x, self.points).astype(float))


class Nearest:
    """The nearest of some centroids for rows whose distances to the pivots are known."""

    def __init__(self, centroids: np.ndarray, pivots: Pivots):
        self.centroids, self.pivots = centroids, pivots
        self.to_pivots = pivots.distances(centroids)

    def bounds(self, cached: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances, rounded down: a row for each vector, a column for each centroid."""
        out = np.zeros((len(cached), len(self.centroids)))
        for i, j, between in self.pivots.pairs:
            a = cached[:, i : i + 1] * self.to_pivots[:, j]
            b = cached[:, j : j + 1] * self.to_pivots[:, i]
            # The slack is taken from the larger product, as a difference loses what its terms were rounded by.
            np.maximum(out, (np.abs(a - b) - SLACK * np.maximum(a, b)) / between * (1 - SLACK), out=out)
        return out

    def __call__(self, x: np.ndarray, cached: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid (of equal ones the smaller), squared distance; and how many were measured."""
        bounds = self.bounds(cached)
        rows = np.arange(len(x))
        best = bounds.argmin(axis=1)
        square = ((x - self.centroids[best]) ** 2).sum(axis=1)
        reach = np.sqrt(square.astype(float)) * (1 + SLACK)
        left = bounds <= reach[:, None]
        left[rows, best] = False
        measured = len(x)
        for c in range(len(self.centroids)):
            at = np.flatnonzero(left[:, c])
            measured += len(at)
            d = ((x[at] - self.centroids[c]) ** 2).sum(axis=1)
            closer = (d < square[at]) | ((d == square[at]) & (c < best[at]))
            best[at[closer]], square[at[closer]] = c, d[closer]
        return best, square, measured


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return values.reshape(len(column), -1)


def with_pivot_distances(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds ``cached``, the distances of each point to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Pivots(pivots)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                flat = of.distances(_matrix(part.column(1), np.int64))
                offsets = pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32())
                cached = pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), cached], ["vec_id", "point", "cached"])

    return points.mapInArrow(lean(run), "vec_id bigint, point array<bigint>, cached array<double>")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, _matrix(part.column(1), np.int64), _matrix(part.column(2), float)


def totals(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> dict[int, tuple[int, int, list[int], int]]:
    """For each non-empty cluster: rows, summed squared distances, summed components, measured distances.

    Each task adds up its own rows, so at most (tasks x clusters) rows are exchanged and
    one row for each cluster comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(centroids, Pivots(pivots))
        k, dim = centroids.shape
        n, inertia, sums, measured = [0] * k, [0] * k, np.zeros((k, dim), object), [0] * k
        for _, x, cached in _parts(batches):
            best, square, work = nearest(x, cached)
            measured[0] += work
            for c in np.unique(best):
                at = best == c
                n[c] += int(at.sum())
                inertia[c] += sum(square[at].tolist())  # Python numbers: no overflow
                sums[c] += x[at].sum(axis=0).astype(object)
        used = [c for c in range(k) if n[c] or measured[c]]
        arrays = [
            pa.array(used, pa.int32()), pa.array([n[c] for c in used], pa.int64()),
            pa.array([str(inertia[c]) for c in used], pa.string()), pa.array([[str(v) for v in sums[c]] for c in used], pa.list_(pa.string())),
            pa.array([measured[c] for c in used], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["cluster", "n", "inertia", "sums", "measured"])

    partial = table.mapInArrow(lean(run), "cluster int, n bigint, inertia string, sums array<string>, measured bigint")
    wide = "decimal(38,0)"
    added = partial.groupBy("cluster").agg(
        F.sum("n"), F.sum(F.col("inertia").cast(wide)),
        F.array(*[F.sum(F.col("sums")[i].cast(wide)) for i in range(centroids.shape[1])]), F.sum("measured"),
    )
    return {r[0]: (r[1], int(r[2]), [int(v) for v in r[3]], r[4]) for r in added.collect()}


def assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` (squared) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(centroids, Pivots(pivots))
        for part, x, cached in _parts(batches):
            best, square, _ = nearest(x, cached)
            arrays = [part.column(0), pa.array(best, pa.int32()), pa.array(square, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "cluster", "distance"])

    return table.mapInArrow(lean(run), "vec_id bigint, cluster int, distance bigint")


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, n_pivots: int = 5,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid`` of each kept vector (see :func:`quantized`).

    Rows with another number of components, or with NULL or non-finite ones, are not kept.
    Centroids start as the ``k`` points of :func:`seeds`; each of ``rounds`` rounds assigns
    all points and replaces each non-empty centroid by the exact floor of its mean. The
    first ``n_pivots`` seeds are the pivots. Repeated rows count as often as they occur;
    fewer than ``k`` kept rows give fewer centroids, and none gives an empty table. Equal
    distances go to the smaller number. A component that could make a squared distance
    leave 64 bits is an error. Other columns are not carried. Only k centroids and their
    sums pass the driver.
    """
    if dim * (2 * LARGEST) ** 2 > 1 << 63:
        raise ValueError(f"{dim} components may leave 64 bits")
    spark = vectors.sparkSession
    points = quantized(vectors, dim, scale)
    centroids = seeds(points, k, seed)
    if not len(centroids):
        empty = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>"
        return spark.createDataFrame([], empty)
    pivots = centroids[:n_pivots].copy()
    table = stored(with_pivot_distances(points, pivots), "pivot_distances")
    for _ in range(rounds):
        for c, (n, _, sums, _) in totals(table, centroids, pivots).items():
            if n:
                centroids[c] = [v // n for v in sums]
    last = totals(table, centroids, pivots)
    inertia = sum(x[1] for x in last.values())
    rows = [(c, int(last[c][1]) if c in last else 0, inertia, centroids[c].tolist()) for c in range(len(centroids))]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return assigned(table, centroids, pivots).join(facts, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )
