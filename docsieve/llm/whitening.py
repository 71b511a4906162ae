"""Whitening of embeddings by an eigendecomposition that grows with the data.

Every task keeps the spectrum of its own vectors by centred rank-one updates (``spectrum``): a
block of vectors is rotated to as many rows as there are dimensions, and each row is one update
through the secular equation.  The tasks' spectra, one row of dimension squared numbers each, are
combined in a tree of bounded groups, again by rank-one updates, one for each eigenvector and one
for the distance of the means.  The basis so found is refined once (Rayleigh-Ritz): tasks project
their centred vectors on it and add up the products, whose small eigenproblem turns the basis into
the eigenvectors to double precision.

Sums are exact integers.  A vector ``x`` is centred as ``(x - floor(S/n)) - (S mod n)/n``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import written
from docsieve.llm.spectrum import Spectrum
from docsieve.llm.vectors import finite_vectors, list_column

#: Vectors of a task that are rotated together before they update its spectrum.
BLOCK = 1024
#: Rows of partial results that one task of the tree combines.
FAN = 16
#: Integers are held to this magnitude.
MOST = 1 << 40
_PART = "slot long, n bigint, total array<bigint>, low array<bigint>, mean array<double>, eigen array<double>, basis array<double>"


@dataclass
class Whitening:
    """What was fitted: ``n`` vectors with componentwise sums ``total``; ``values`` falling, eigenvectors in columns."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    scale: float
    shift: int

    @property
    def size(self) -> int:
        return len(self.total)

    def positive(self, components: int) -> np.ndarray:
        """Which of the first components have a variance above rounding."""
        e = self.values[:components]
        return e > 64 * self.size * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)

    def matrix(self, components: int) -> np.ndarray:
        """Centred vectors times this are whitened; a component without variance gives NaN."""
        e = self.values[:components]
        some = self.positive(components)
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.vectors[:, :components] * np.where(some, 1 / np.sqrt(np.where(some, e, 1)), np.nan)


def _integers(matrix: np.ndarray, scale: float, shift: int) -> np.ndarray:
    return np.clip(np.floor(matrix * scale), -MOST, MOST).astype(np.int64) + shift


def _centred(x: np.ndarray, total: list[int], n: int) -> np.ndarray:
    whole = np.array([s // n for s in total], np.int64)
    rest = np.array([(s % n) / n for s in total])
    return (x - whole).astype(float) - rest


def _matrices(batches: Iterator[pa.RecordBatch], size: int, scale: float, shift: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, kept rows, integer vectors) of batches whose last column is the vector."""
    for batch in batches:
        rows, matrix = finite_vectors(batch.column(batch.num_columns - 1), size)
        if len(rows):
            yield batch, rows, _integers(matrix, scale, shift)


def _spectra(size: int, scale: float, shift: int) -> Callable:
    """A task's number of vectors, exact sums (halves of 32 bits, so that no sum overflows) and spectrum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, high, low = Spectrum.empty(size), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for _, _, x in _matrices(batches, size, scale, shift):
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
            for first in range(0, len(x), BLOCK):
                own.add(x[first: first + BLOCK].astype(float))
        if own.n:
            slot = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([slot], pa.int64()), pa.array([own.n], pa.int64()), list_column(high[None], pa.int64()), list_column(low[None], pa.int64()),
                 *(list_column(a.reshape(1, -1), pa.float64()) for a in (own.mean, own.values, own.vectors))],
                ["slot", "n", "total", "low", "mean", "eigen", "basis"])
    return run


def _combined(size: int) -> Callable:
    def run(parts: pd.DataFrame) -> pd.DataFrame:
        own = Spectrum.empty(size)
        for part in parts.sort_values("slot").itertuples():
            own.merge(Spectrum(int(part.n), np.array(part.mean), np.array(part.eigen), np.array(part.basis).reshape(size, size)))
        return pd.DataFrame({"slot": [parts["slot"].iloc[0] // FAN], "n": [own.n], "mean": [own.mean], "eigen": [own.values], "basis": [own.vectors.ravel()]})
    return run


def _added(parts: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"slot": [parts["slot"].iloc[0] // FAN], "products": [np.sum(parts.sort_values("slot")["products"].tolist(), axis=0)]})


def _in_tree(parts: DataFrame, combine: Callable, slots: int) -> DataFrame:
    """One row from parts with slots 0 to ``slots`` - 1, by groups of at most ``FAN`` rows."""
    while slots > 1:
        parts = parts.groupBy(F.expr(f"slot div {FAN}")).applyInPandas(combine, parts.schema)
        slots = -(-slots // FAN)
    return parts


def _products(fit: Whitening, matrix: np.ndarray) -> Callable:
    """A task's sums of y and of y y^T, y being its centred vectors times ``matrix``."""
    width = matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width + 1, width))
        for _, _, x in _matrices(batches, fit.size, fit.scale, fit.shift):
            y = _centred(x, fit.total, fit.n) @ matrix
            sums += np.vstack([y.T @ y, y.sum(axis=0)])
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), list_column(sums.reshape(1, -1), pa.float64())], ["slot", "products"])
    return run


def _covariance(vectors: DataFrame, fit: Whitening, matrix: np.ndarray) -> np.ndarray:
    """Covariance (divisor n) of the fit's centred vectors times ``matrix``."""
    width = matrix.shape[1]
    parts = vectors.mapInArrow(_products(fit, matrix), "slot long, products array<double>")
    parts = written(parts, "products")
    top = parts.agg(F.max("slot")).first()[0]
    if top is None:
        return np.zeros((width, width))
    sums = np.array(_in_tree(parts, _added, top + 1).first()["products"]).reshape(width + 1, width) / fit.n
    return sums[:-1] - np.outer(sums[-1], sums[-1])


def fit_whitening(vectors: DataFrame, scale: float = 1024, shift: int = 100_000) -> Whitening | None:
    """Eigenvectors of the covariance of ``vectors`` (column embedding) as integers floor(scale * entry) + shift.

    Null vectors and those with a null or non-finite entry are left out; so are vectors of another
    length than most of the remaining ones (of two such lengths the larger), which share no space
    with them.  Repeated rows count each time.  None if nothing remains.  Integers are held to 2**40.
    """
    vectors = vectors.select("embedding")
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    length = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite).groupBy(F.size("embedding").alias("size")).count().orderBy(
        F.desc("count"), F.desc("size")).first()
    if length is None:
        return None
    size = length["size"]
    parts = written(vectors.mapInArrow(_spectra(size, scale, shift), _PART), "spectra")
    sums = [F.sum(F.col(c)[j].cast("decimal(38,0)")) for c in ("total", "low") for j in range(size)]
    row = parts.agg(F.sum("n"), F.max("slot"), F.array(*sums)).first()
    total = [(int(h) << 32) + int(lo) for h, lo in zip(row[2][:size], row[2][size:], strict=True)]
    one = _in_tree(parts.drop("total", "low"), _combined(size), row[1] + 1).first()
    basis, _ = np.linalg.qr(np.array(one["basis"]).reshape(size, size))
    fit = Whitening(int(row[0]), total, np.zeros(size), basis, scale, shift)
    values, turn = np.linalg.eigh(_covariance(vectors, fit, basis))
    fit.values, fit.vectors = np.maximum(values[::-1], 0), basis @ turn[:, ::-1]
    fit.vectors *= np.sign(fit.vectors[np.abs(fit.vectors).argmax(axis=0), np.arange(size)])  # the largest entry is positive
    return fit


def _exact_deviation(x: np.ndarray, total: list[int], n: int) -> list[int]:
    """Sum over dimensions of (n*x - S)^2, in integers: n^2 sum a^2 - 2 n sum a r + sum r^2 with x = a + S//n, r = S mod n."""
    a = x - np.array([s // n for s in total], np.int64)
    r = np.array([s % n for s in total], np.int64)
    bound = int(np.abs(a).max(initial=0)) + 1
    if x.shape[1] * bound * max(bound, n) >> 62:
        a, r = a.astype(object), r.astype(object)
    rest = sum(int(v) ** 2 for v in r)
    return [n * n * int(p) - 2 * n * int(q) + rest for p, q in zip((a * a).sum(axis=1), (a * r).sum(axis=1), strict=True)]


def _whitened(fit: Whitening, components: int) -> Callable:
    matrix = fit.matrix(components)
    most = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, x in _matrices(batches, fit.size, fit.scale, fit.shift):
            y = _centred(x, fit.total, fit.n) @ matrix
            deviation = _exact_deviation(x, fit.total, fit.n)
            values = pa.array(y.ravel(), pa.float64(), from_pandas=True)  # NaN becomes null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)).cast(pa.int64()), pa.array([d if d <= most else None for d in deviation], pa.int64()),
                 pa.array(map(str, deviation), pa.string()), lists], ["vec_id", "deviation", "deviation_exact", "whitened"])
    return run


def whiten(vectors: DataFrame, fit: Whitening, components: int = 8) -> DataFrame:
    """vec_id, deviation, deviation_exact (a text of digits), whitened (array of the first components) of each vector of the fit's length.

    ``deviation`` is null where the exact integer exceeds a long; ``whitened`` is null for a
    component without variance.  Other columns are ignored; an empty table gives no rows.
    """
    components = min(components, fit.size)
    return vectors.select("vec_id", "embedding").mapInArrow(
        _whitened(fit, components), "vec_id long, deviation bigint, deviation_exact string, whitened array<double>")


def identity_error(vectors: DataFrame, fit: Whitening, components: int = 8) -> float | None:
    """Largest entry, in magnitude, of the whitened vectors' covariance minus the identity; None without any variance."""
    some = fit.positive(min(components, fit.size))
    if not some.any():
        return None
    matrix = fit.matrix(len(some))[:, some]
    return float(np.abs(_covariance(vectors.select("embedding"), fit, matrix) - np.eye(matrix.shape[1])).max())


def whitened_components(vectors: DataFrame, components: int = 8, scale: float = 1024, shift: int = 100_000) -> DataFrame:
    """A row per remaining vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error, deviation_exact.

    Which vectors remain, and the results for nulls and other lengths, are those of
    ``fit_whitening`` and ``whiten``; a repeated row has its rows each time, an empty table none.
    ``explained`` is null if nothing varies.
    """
    fit = fit_whitening(vectors, scale, shift)
    if fit is None:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    trace = float(fit.values.sum())
    shares = F.array(*[F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in fit.values[:components]])
    rows = whiten(vectors, fit, components).select("*", F.posexplode("whitened").alias("place", "value"))
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"),
                       shares[F.col("place")].alias("explained"), F.lit(identity_error(vectors, fit, components)).cast("double").alias("identity_error"), "deviation_exact")


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
