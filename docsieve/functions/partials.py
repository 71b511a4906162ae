"""Sums and lowest rows of groups, made by a task in one pass over its rows.

Spark has no aggregate that keeps the lowest few rows of a group in a buffer of that size; a window
sorts all rows for it.  Here a task holds the lowest so far of each group, and a row that is not
below them is dropped as it comes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WAITING = 2048  # rows that may wait before the lists are cut again


class _Lowest:
    """Of each group the ``listed`` lowest (score, id) of the rows so far; rows without an ordinary score all stay."""

    def __init__(self, listed: int) -> None:
        self.listed, self.rows, self.cut_at = listed, None, WAITING
        self.score, self.id = np.zeros(0), None  # the highest of a full list, by group

    def add(self, group: np.ndarray, groups: int, score: pa.Array, ids: pa.Array) -> None:
        if groups > len(self.score):
            self.score = np.append(self.score, np.full(groups - len(self.score), np.inf))
        value = score.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        odd = np.isnan(value)
        below = odd | (value <= self.score[group])
        at = np.flatnonzero(below)
        if self.id is not None:
            known = group[at] < len(self.id)
            limit = pc.take(self.id, pa.array(np.where(known, group[at], 0)))
            within = pc.fill_null(pc.less_equal(ids.take(pa.array(at)), limit), True).to_numpy(zero_copy_only=False)
            at = at[odd[at] | (value[at] < self.score[group[at]]) | ~known | within]
        if not len(at):
            return
        some = pa.table({"group": group[at], "odd": odd[at], "value": value[at], "score": score.take(pa.array(at)), "id": ids.take(pa.array(at))})
        self.rows = some if self.rows is None else pa.concat_tables([self.rows, some])
        if self.rows.num_rows >= self.cut_at:
            self.cut(groups)

    def cut(self, groups: int) -> None:
        if self.rows is None:
            return
        rows = self.rows.take(pc.sort_indices(self.rows, [("odd", "ascending"), ("group", "ascending"), ("value", "ascending"), ("id", "ascending")], null_placement="at_start"))
        odd, group = rows["odd"].to_numpy(), rows["group"].to_numpy()
        plain = int((~odd).sum())
        first = np.flatnonzero(np.append(True, group[1:plain] != group[:plain - 1])) if plain else np.zeros(0, np.int64)
        place = np.arange(plain) - np.repeat(first, np.diff(np.append(first, plain)))
        last = np.flatnonzero(place == self.listed - 1)
        self.score = np.full(groups, np.inf)
        self.score[group[last]] = rows["value"].to_numpy()[last]
        at = np.full(groups, -1)
        at[group[last]] = last
        self.id = rows["id"].combine_chunks().take(pa.array(at, mask=at < 0))
        self.rows = rows.take(pa.array(np.append(np.flatnonzero(place < self.listed), np.arange(plain, len(odd)))))
        self.cut_at = 2 * self.rows.num_rows + WAITING


def sums_and_lowest(keys: int, listed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: rows of ``keys`` key columns, score, id in; per group its keys, samples, total and
    lowest (a list of score, id) out.  Nulls are left out of samples and total.

    The lists hold the ``listed`` lowest by (score, id), and perhaps more; rows whose score is null or not a
    number are all among them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        lowest, samples, totals, schema = _Lowest(listed), np.zeros(0, np.int64), np.zeros(0), None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            code, values = np.zeros(batch.num_rows, np.int64), []
            for column in batch.columns[:keys]:
                coded = column.dictionary_encode(null_encoding="encode")
                values.append(coded.dictionary)
                # numbers of the combinations so far stay below the number of rows
                _, code = np.unique(code * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
            _, sample, code = np.unique(code, return_index=True, return_inverse=True)
            of_batch = zip(*(column.take(pa.array(sample)).to_pylist() for column in batch.columns[:keys]))
            number = np.array([known.setdefault(key, len(known)) for key in of_batch], np.int64)
            group, score = number[code], batch.column(keys)
            grown = len(known) - len(samples)
            samples, totals = np.append(samples, np.zeros(grown, np.int64)), np.append(totals, np.zeros(grown))
            samples += np.bincount(group, score.is_valid().to_numpy(zero_copy_only=False), len(known)).astype(np.int64)
            with np.errstate(invalid="ignore"):  # scores of both infinities
                totals += np.bincount(group, score.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), len(known))
            lowest.add(group, len(known), score, batch.column(keys + 1))
        if schema is None:
            return
        lowest.cut(len(known))
        rows = lowest.rows.take(pc.sort_indices(lowest.rows, [("group", "ascending")])).combine_chunks()
        of_group = np.searchsorted(rows["group"].to_numpy(), np.arange(len(known) + 1))
        pairs = pa.StructArray.from_arrays([rows["score"].combine_chunks(), rows["id"].combine_chunks()], names=["score", "sample_id"])
        names = list(zip(*known))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(column, schema.field(i).type) for i, column in enumerate(names)),
             pa.array(samples), pa.array(totals), pa.ListArray.from_arrays(pa.array(of_group, pa.int32()), pairs)],
            names=[*schema.names[:keys], "samples", "total", "lowest"])
    return run
