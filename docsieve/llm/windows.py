"""Windows of a text grouped by their minimizer, shared by the two substring operators.

A window is k consecutive symbols.  Its minimizer is the m-gram with the least hash inside
it, the leftmost on ties.  Consecutive windows with the same minimizer form a piece.  Two
equal windows have the same minimizer at the same place, wherever they occur, so pieces with
different minimizers share no window: the minimizer partitions the search for repeats.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from docsieve.llm.common import span_hash


class Pieces(NamedTuple):
    row: np.ndarray  # text
    start: np.ndarray  # first window, counted from the text's first symbol
    count: np.ndarray  # windows
    anchor: np.ndarray  # place of the minimizer in the run of texts
    key: np.ndarray  # hash of the minimizer
    content: np.ndarray  # hash of all symbols of the piece


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value in each window of ``width`` values, the leftmost on ties."""
    best, place, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        n = len(best) - step
        take = best[step:] < best[:n]
        best = np.where(take, best[step:], best[:n])
        place = np.where(take, place[step:], place[:n])
        have += step
    return place


def pieces(prefix: np.ndarray, offsets: np.ndarray, k: int, m: int) -> Pieces:
    """Pieces of a run of texts; ``prefix`` is the prefix hash of their symbols, ``offsets`` their bounds."""
    n = len(prefix) - 1
    empty = np.zeros(0, np.int64)
    if n < k:
        return Pieces(empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    starts = np.arange(n - m + 1)
    grams = span_hash(prefix, starts, starts + m)
    place = _sliding_least(grams, k - m + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - k + 1]
    at = np.flatnonzero(np.arange(n - k + 1) + k <= offsets[row + 1])
    if not len(at):
        return Pieces(empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    new = np.ones(len(at), bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    begin = at[first]
    return Pieces(row[begin], begin - offsets[row[begin]], count, place[begin], grams[place[begin]], span_hash(prefix, begin, begin + count + k - 1))
