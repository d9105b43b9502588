"""Centroid clustering with a LAESA pivot table.

Vectors become integers, floor(256 x). The distances of every vector to a few
fixed pivots are computed once and stored beside it. In a round, the distances of
the centroids to the pivots are known, and |d(v, p) - d(c, p)| <= d(v, c) for
each pivot p (triangle inequality). A vector first meets the centroid with the
least bound; only centroids whose bound does not exceed that distance get an
exact integer distance.

A round is one pass over the stored table. A task returns one row per cluster and
component, with exact sums, so a cluster with any share of the vectors arrives as
one row per task. The driver holds the centroids and the pivots, whose number and
width are parameters, and divides the sums.

Pivots are chosen among the starting centroids, each in turn the one with the
largest sum of distances to the pivots so far.

Defined cases: vectors that are null, hold null or non-finite components or have
another width take no part; a null id comes after all ids when centroids are
chosen, and rows with equal ids are chosen by their components; fewer vectors
than clusters give fewer clusters; equal distances go to the smaller number; an
empty cluster keeps its centroid; repeated rows are vectors of their own;
components are held at +-2^53 and distances and sums of them at the largest
long; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staging
from .storage import written

CLUSTERS, ROUNDS, WIDTH, PIVOTS = 40, 5, 64, 8
SCALE = 256
_LIMIT = 1 << 53
# Squares of differences of smaller components add up exactly in a double.
_SMALL = 1 << 20
_MOST = np.iinfo(np.int64).max
_STEP = 4096


def integers(vectors: DataFrame, width: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors of the width with components floor(256 x)."""
    raw = F.transform(vector_col, lambda x: x.cast("double"))
    valid = (F.size(raw) == width) & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = F.transform(raw, lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(_LIMIT))), F.lit(-float(_LIMIT)))).cast("bigint"))
    return vectors.filter(F.coalesce(valid, F.lit(False))).select(F.col(id_col).cast("bigint").alias("vec_id"), held.alias("v"))


def start(points: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the least hash of ``<seed>:<vec_id>``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.orderBy(F.asc_nulls_last(key), "v").limit(clusters).select("v").collect()
    return np.array([r.v for r in rows], dtype=np.int64) if rows else np.zeros((0, 0), dtype=np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of row pairs: long, or Python integers where they are large."""
    if not a.size or max(abs(int(x)) for m in (a, b) if m.size for x in (m.min(), m.max())) <= _SMALL:
        d = a - b
        return np.einsum("ij,ij->i", d, d)
    d = a.astype(object) - b.astype(object)
    return (d * d).sum(axis=1)


def _roots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to all rows of ``b``."""
    columns = [np.sqrt(squared(a, np.broadcast_to(row, a.shape)).astype(float)) for row in b]
    return np.column_stack(columns) if columns else np.zeros((len(a), 0))


def choose(candidates: np.ndarray, pivots: int) -> np.ndarray:
    """Pivots that lie far from each other."""
    if not len(candidates):
        return candidates
    apart = _roots(candidates, candidates)
    picked = [int(apart.sum(axis=1).argmax())]
    while len(picked) < min(pivots, len(candidates)):
        total = apart[:, picked].sum(axis=1)
        total[picked] = -1
        picked.append(int(total.argmax()))
    return candidates[picked]


class Assignment:
    """The nearest centroid by pivot bounds, then exact distances of the survivors."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids = centroids
        self.to_pivots = _roots(centroids, pivots)
        self.exact = 0

    def nearest(self, v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of vectors ``v`` with pivot distances ``at``."""
        bound = np.zeros((len(v), len(self.centroids)))
        for of_v, of_c in zip(at.T, self.to_pivots.T):
            apart = np.abs(of_v[:, None] - of_c[None, :])
            # Roots are rounded, so a bound may not count to the last digit.
            np.maximum(bound, apart - 1e-12 * (of_v[:, None] + of_c[None, :]), out=bound)
        cluster = bound.argmin(axis=1)
        best = squared(v, self.centroids[cluster])
        near = bound <= np.sqrt(best.astype(float))[:, None] * (1 + 1e-12)
        near[np.arange(len(v)), cluster] = False
        row, other = np.nonzero(near)
        found = squared(v[row], self.centroids[other])
        self.exact += len(v) + len(row)
        every = (np.concatenate([np.arange(len(v)), row]), np.concatenate([cluster, other]), np.concatenate([best, found]))
        order = np.lexsort((every[1], every[2], every[0]))
        row, other, found = (x[order] for x in every)
        first = np.searchsorted(row, np.arange(len(v)))
        return other[first], found[first]


def _vectors(batch: pa.RecordBatch, name: str, kind: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(batch.num_rows, -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, _STEP):
            yield batch.slice(lo, _STEP)


def table(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``points`` with their distances to the pivots as ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            at = _roots(_vectors(batch, "v", "i8"), pivots)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype="i4") * len(pivots)), pa.array(at.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists], names=["vec_id", "v", "at"])

    return points.mapInArrow(run, "vec_id bigint, v array<bigint>, at array<double>")


def _held(values: np.ndarray) -> np.ndarray:
    return values if values.dtype == np.int64 else np.array([min(int(x), _MOST) for x in values], dtype=np.int64)


def assign(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of a stored pivot table; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Assignment(centroids, pivots)
        for batch in _slices(batches):
            cluster, distance = found.nearest(_vectors(batch, "v", "i8"), _vectors(batch, "at", "f8"))
            columns = [batch.column("vec_id"), pa.array(cluster.astype("i4")), pa.array(_held(distance))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return stored.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


_SUMS = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("total", pa.decimal128(38, 0)), ("size", pa.int64())])


def sums(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(cluster, place, total, size): exact sums of each component of each cluster's vectors."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Assignment(centroids, pivots)
        total, size = np.zeros((k, width), dtype=object), np.zeros(k, dtype=np.int64)
        for batch in _slices(batches):
            v = _vectors(batch, "v", "i8")
            cluster, _ = found.nearest(v, _vectors(batch, "at", "f8"))
            order = np.argsort(cluster, kind="stable")
            present, first = np.unique(cluster[order], return_index=True)
            # A slice of 4096 components up to 2^53 would pass the range of a long.
            wide = v.astype(object) if np.abs(v).max(initial=0) > _SMALL else v
            total[present] += np.add.reduceat(wide[order], first, axis=0) if len(first) else 0
            size += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(size)
        columns = [
            np.repeat(used, width).astype("i4"), np.tile(np.arange(width, dtype="i4"), len(used)),
            pa.array([decimal.Decimal(int(x)) for x in total[used].ravel()], pa.decimal128(38, 0)), np.repeat(size[used], width),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_SUMS)

    parts = stored.mapInArrow(run, "cluster int, place int, total decimal(38,0), size bigint")
    return parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("size").alias("size"))


def moved(centroids: np.ndarray, totals: DataFrame) -> np.ndarray:
    """Centroids replaced by the floor of their vectors' means; fetches one row per component."""
    after = centroids.copy()
    for r in totals.collect():
        after[r.cluster, r.place] = int(r.total) // r.size
    return after


def clusters(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, *, n_pivots: int = PIVOTS,
    seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) written once, and the final centroids).

    Runs its jobs when called: one for the start, one for the pivot table, one a
    round and one for the result.
    """
    points = integers(vectors, width, id_col, vector_col)
    centroids = start(points, k, seed)
    pivots = choose(centroids, n_pivots)
    if not len(centroids):
        return points.selectExpr("vec_id", "0 cluster", "0L distance").limit(0), centroids
    with staging(vectors.sparkSession) as stage:
        stored = stage(table(points, pivots), "pivots")
        for _ in range(rounds):
            centroids = moved(centroids, sums(stored, centroids, pivots))
        return written(assign(stored, centroids, pivots), "clusters"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256; broadcasts one row per centroid."""
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    found = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(total.alias("total")).collect()}
    whole = min(sum(found.values()), _MOST)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(i, min(t, _MOST), whole, names[i]) for i, t in sorted(found.items())]
    about = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
