"""Clustering around centroids of integer vectors, with dot products kept per vector.

A squared distance is ``|x|^2 - 2 x.c + |c|^2``.  The products ``x.c`` with all centroids are a
column of the vectors' table, exact as integers.  When a centroid moves, only its components that
changed enter: ``x.c' = x.c + sum over changed j of x[j] * (c'[j] - c[j])``; then the nearest
centroid is chosen anew from the products.  Each assignment is a table of the shared folder, so a
lost executor costs tasks of one round, and the table before it is removed.

Centroids and their sums (``k`` times ``size`` numbers) are all that the driver holds.  Sums are
added up inside tasks, one row a cluster and task, so a cluster with most vectors is no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import forget, written
from docsieve.llm.vectors import finite_vectors, list_column

#: Integers are held to this magnitude (entries of 2**21 at scale 64), so that distances fit a long.
MOST = 1 << 27
_STATE = "vec_id long, x array<int>, dots array<bigint>, cluster int, distance bigint"


def _integers(scale: float, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, matrix = finite_vectors(batch.column(1), size)
            x = np.clip(np.floor(matrix * scale), -MOST, MOST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)).cast(pa.int64()), list_column(x, pa.int32())], ["vec_id", "x"])
    return run


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(-1, size)


def _assigned(batch: pa.RecordBatch, x: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> pa.RecordBatch:
    """Nearest centroid of each vector by its dot products; of equal distances the smaller number."""
    distance = (x * x).sum(axis=1)[:, None] - 2 * dots + (centroids * centroids).sum(axis=1)
    cluster = distance.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), list_column(dots, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance[np.arange(len(x)), cluster], pa.int64())],
        ["vec_id", "x", "dots", "cluster", "distance"])


def _first(centroids: np.ndarray) -> Callable:
    """All dot products of vectors that have none yet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), centroids.shape[1])
            yield _assigned(batch, x, x @ centroids.T, centroids)
    return run


def _moved(old: np.ndarray, new: np.ndarray) -> Callable:
    """Dot products after the centroids moved, by their changed components alone."""
    change = new - old
    parts = [(k, np.flatnonzero(change[k])) for k in range(len(new)) if change[k].any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), new.shape[1])
            dots = _matrix(batch.column(2), len(new)).copy()
            for k, changed in parts:
                dots[:, k] += x[:, changed] @ change[k, changed]
            yield _assigned(batch, x, dots, new)
    return run


def _sums(k: int, size: int) -> Callable:
    """Number and componentwise sum of each cluster's vectors in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            cluster = np.asarray(batch.column(0)).astype(np.int64)
            member = (cluster[None, :] == np.arange(k)[:, None]).astype(np.int64)
            number += member.sum(axis=1)
            total += member @ _matrix(batch.column(1), size)
        some = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(number[some], pa.int64()), list_column(total[some], pa.int64())], ["cluster", "n", "total"])
    return run


def _next_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of every cluster that has vectors; the others stay."""
    k, size = centroids.shape
    parts = state.select("cluster", "x").mapInArrow(_sums(k, size), "cluster int, n bigint, total array<bigint>")
    new = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[j]) for j in range(size)]).alias("total")).collect():
        new[row["cluster"]] = [t // row["n"] for t in row["total"]]
    return new


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: float = 64, size: int = 64, seed: int = 1) -> DataFrame:
    """Clusters of the rows of ``vectors`` (vec_id, embedding), all other columns ignored.

    Entries become integers floor(scale * entry).  The first centroids are the ``k`` vectors with
    the least SHA-256 of ``<seed>:<vec_id>``; ``rounds`` times all vectors are assigned to the
    nearest centroid and every cluster that has vectors moves to the floor of its mean; then all
    are assigned once more.  Columns: vec_id, cluster, distance (squared, to the final centroid),
    cluster_inertia, inertia (sums of distances), centroid_sha256, centroid (its components).

    Null vectors, those of another length and those with a null or non-finite entry have no row.
    Every other row has one, repeated ids and rows too; a null id counts as the empty text when
    first centroids are chosen, and equal hashes go by components.  With fewer than ``k`` vectors
    there are as many centroids as vectors, and an empty table gives an empty result.  Integers
    are held to 2**27 in magnitude (entries beyond 2**21 at scale 64); sums beyond a long stay at its end.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_integers(scale, size), "vec_id long, x array<int>")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(rank.alias("rank"), "x").orderBy("rank", "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], _RESULT)
    centroids = np.array([row["x"] for row in first], np.int64)
    state = written(kept.mapInArrow(_first(centroids), _STATE), "clusters")
    for _ in range(rounds):
        new = _next_centroids(state, centroids)
        before, state = state, written(state.mapInArrow(_moved(centroids, new), _STATE), "clusters")
        forget(before)
        centroids = new
    inertia = {row["cluster"]: int(row["d"]) for row in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total, most = sum(inertia.values()), (1 << 63) - 1
    table = spark.createDataFrame(
        [(c, min(d, most), min(total, most), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest(), centroids[c].tolist()) for c, d in inertia.items()],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(table), "cluster").select(*_COLUMNS)  # k rows


_RESULT = "vec_id long, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>"
_COLUMNS = [part.split()[0] for part in _RESULT.split(", ")]
