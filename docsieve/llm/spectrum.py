"""Eigendecompositions of scatter matrices kept up to date by rank-one updates.

``D + u u^T`` with ``D`` diagonal has the roots of the secular equation
``1 + sum u_i^2 / (d_i - x) = 0`` as eigenvalues, one between each two neighbours of ``D``.
Entries of ``u`` that are next to nothing leave their eigenpair as it is, and of equal diagonal
entries all but one are rotated to nothing (deflation).  The entries of ``u`` are then recomputed
from the roots, which makes the eigenvectors orthogonal whatever error the roots have.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_EPS = np.finfo(float).eps
_HALVINGS = 44


def _rotate_ties(d: np.ndarray, u: np.ndarray, q: np.ndarray, small: float) -> None:
    """Of neighbouring equal entries of ``d`` (ascending) leave weight on the last one only."""
    for i in np.flatnonzero(np.diff(d) <= small):
        if u[i]:
            r = np.hypot(u[i], u[i + 1])
            c, s = u[i + 1] / r, u[i] / r
            u[i], u[i + 1] = 0.0, r
            left = q[:, i].copy()
            q[:, i] = c * left - s * q[:, i + 1]
            q[:, i + 1] = s * left + c * q[:, i + 1]


def _roots(d: np.ndarray, u2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(``d_j - x_i`` for all roots x_i in rows, ``x_i``) of the secular equation.

    Each root is measured from the nearer pole and its distance halved on a logarithmic scale, so
    that the smallest distances are as exact as the largest.
    """
    room = np.append(np.diff(d), u2.sum())
    gap = d[None, :] - d[:, None]  # d_j - d_i
    beyond = 1 + (u2 / (gap - room[:, None] / 2)).sum(axis=1) < 0  # the root lies in the upper half
    right = beyond.copy()
    right[-1] = False  # no pole above the last
    side, pole = np.where(right, -1.0, 1.0), np.arange(len(d)) + right
    shifted = d[None, :] - d[pole][:, None]
    high = np.where(right | ~beyond, room / 2, room)
    low = high * 1e-18
    for _ in range(_HALVINGS):
        t = np.sqrt(low) * np.sqrt(high)
        farther = (1 + (u2 / (shifted - (side * t)[:, None])).sum(axis=1) < 0) ^ right
        low, high = np.where(farther, t, low), np.where(farther, high, t)
    t = side * np.sqrt(low) * np.sqrt(high)
    return shifted - t[:, None], d[pole] + t


def rank_one(d: np.ndarray, q: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``q diag(d) q^T + z z^T``."""
    u = z @ q
    weight = float(u @ u)
    scale = max(abs(d[0]), abs(d[-1]), weight)
    if weight <= _EPS * _EPS * scale or not scale:
        return d, q
    q = q.copy()
    _rotate_ties(d, u, q, 8 * _EPS * scale)
    live = np.flatnonzero(u * u > (8 * _EPS) ** 2 * scale)
    if not len(live):
        return d, q
    dl, ul = d[live], u[live]
    minus, d_live = _roots(dl, ul * ul)  # minus[i, j] = d_j - x_i
    # u_j^2 = prod_i (x_i - d_j) / prod_{i != j} (d_i - d_j), factors paired to stay near one
    between = dl[:, None] - dl[None, :]
    np.fill_diagonal(between, 1.0)
    ratio = -minus / between
    weights = np.sqrt(np.abs(np.prod(ratio, axis=0))) * np.sign(ul)
    w = weights / minus
    w /= np.linalg.norm(w, axis=1)[:, None]
    d = d.copy()
    d[live] = d_live
    q[:, live] = q[:, live] @ w.T
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


@dataclass
class Spectrum:
    """Scatter of ``n`` vectors around their ``mean``: ``vectors diag(values) vectors^T``."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def absorb(self, n: int, mean: np.ndarray, rows: np.ndarray) -> None:
        """Add ``n`` vectors with this mean whose centred scatter is ``rows^T rows``, one rank-one update a row.

        The distance between the means is one more update, which keeps the scatter centred.
        """
        if not n:
            return
        if self.n:
            rows = np.vstack([rows, np.sqrt(self.n * n / (self.n + n)) * (mean - self.mean)])
        for row in rows:
            self.values, self.vectors = rank_one(self.values, self.vectors, row)
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def add(self, block: np.ndarray) -> None:
        """Add a block of vectors; more rows than entries are first rotated to as many rows of the same scatter."""
        mean = block.mean(axis=0)
        rows = block - mean
        self.absorb(len(block), mean, np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows)

    def merge(self, other: Spectrum) -> None:
        """Add another spectrum by successive rank-one updates with its scaled eigenvectors."""
        self.absorb(other.n, other.mean, (other.vectors * np.sqrt(np.maximum(other.values, 0))).T)
