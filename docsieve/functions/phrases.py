"""The phrase found first in a text, out of a table of phrases of any size.

The phrases are files of the shared folder, in the order of their lengths and hashes.  A Python worker
reads the hashes once and keeps them, some ten bytes a phrase; the phrases stay in the files.  The
hashes of all stretches of a batch's texts tell which phrases may occur in it.  These few are read, and
an automaton (Aho-Corasick) of them finds the first one, exactly and in one pass over a text.  So a
row's time does not depend on the number of phrases, nor a worker's memory on their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.session import scratch_dir
from docsieve.sources.remote import opened

SHARD = 200_000
FILES = 64            # at most; every worker reads the hashes of all of them
GROUP_BYTES = 1 << 20  # of phrases that lie together in a file: what is read to get one of them
KEPT = 1 << 14        # phrases that a worker keeps once it has read them
SEARCHED = 1 << 20    # characters hashed at a time
_HIT = "struct<at:int,ordinal:int,type:string>"
_ARROW = pa.struct([("at", pa.int32()), ("ordinal", pa.int32()), ("type", pa.string())])
_BUILT: dict[str, _Index] = {}  # the worker's phrases, by folder


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _both(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    return _mixed(left * np.uint64(0xC2B2AE3D27D4EB4F) + right + np.uint64(n))


def _stretches(text: str, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(a, hashes of the ``a`` characters from every position), for the powers of two up to ``longest``."""
    a, hashes = 1, _mixed(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    while a <= longest and len(hashes):
        yield a, hashes
        hashes = _both(hashes[:-a], hashes[a:], a)
        a *= 2


def _hashes(phrases: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, key, head) of each: the head is the hash of its first 2**k characters, the most that it
    holds, and the key joins that with the hash of its last 2**k."""
    size = np.array([len(p) for p in phrases], np.int64)
    start, key, head = np.cumsum(size) - size, np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
    for a, hashes in _stretches("".join(phrases), int(size.max(initial=0))):
        own = (size >= a) & (size < 2 * a)
        head[own] = hashes[start[own]]
        key[own] = _both(head[own], hashes[start[own] + size[own] - a], 0)
    return size, key, head


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, key, head = _hashes(batch.column(0).to_pylist())
        more = [pa.array(size, pa.int32()), pa.array(key.view(np.int64)), pa.array(head.view(np.int64))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*_PHRASES.names, "size", "key", "head"])


class _Bits:
    """A set of hashes that now and then holds one more: two bytes a hash."""

    def __init__(self, number: int) -> None:
        n = 1 << max(10, (2 * number - 1).bit_length())
        self.mask, self.table = np.uint64(n - 1), np.zeros(n, np.uint8)

    def _places(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ((some >> np.uint64(3)) & self.mask).astype(np.int64), np.uint8(1) << (some & np.uint64(7)).astype(np.uint8)

    def add(self, some: np.ndarray) -> None:
        np.bitwise_or.at(self.table, *self._places(some))

    def holds(self, some: np.ndarray) -> np.ndarray:
        at, bit = self._places(some)
        return (self.table[at] & bit) != 0


class _Index:
    """Phrases of a folder by hash; their rows are numbered in the order of the files."""

    def __init__(self, folder: str) -> None:
        self.system, path = opened(folder)
        self.files = sorted(i.path for i in self.system.get_file_info(fs.FileSelector(path)) if i.base_name.endswith(".parquet") and i.base_name[0] not in "._")
        self.known: dict[int, dict] = {}
        shapes, counts = [], {}
        for number, file in enumerate(self.files):
            footer = pq.read_metadata(file, filesystem=self.system)
            shapes += [(number, group, footer.row_group(group).num_rows) for group in range(footer.num_row_groups)]
        self.groups = shapes
        self.first = np.cumsum([0] + [rows for *_, rows in shapes])
        self.keys = np.empty(int(self.first[-1]), np.int64)
        at = 0
        for number in range(len(self.files)):
            size, key = (c.to_numpy() for c in self._read(number, ["size", "key"]).columns)
            self.keys[at:at + len(key)] = key
            at += len(key)
            for n, rows in zip(*np.unique(size, return_counts=True)):
                counts[int(n)] = counts.get(int(n), 0) + int(rows)
        # rows lie by length, then by key
        ends = dict(zip(sorted(counts), np.cumsum([counts[n] for n in sorted(counts)]).tolist()))
        self.by_length = {n: (end - counts[n], end) for n, end in ends.items()}
        self.longest = max(counts, default=0)
        held = lambda a: sum(rows for n, rows in counts.items() if a <= n < 2 * a)
        self.heads = {1 << k: _Bits(held(1 << k)) for k in range(self.longest.bit_length()) if held(1 << k)}
        for number in range(len(self.files)):
            size, head = (c.to_numpy() for c in self._read(number, ["size", "head"]).columns)
            for a, bits in self.heads.items():
                bits.add(head[(size >= a) & (size < 2 * a)].view(np.uint64))

    def _read(self, file: int, columns: list[str], group: int | None = None) -> pa.Table:
        with self.system.open_input_file(self.files[file]) as source:
            table = pq.ParquetFile(source)
            return table.read(columns) if group is None else table.read_row_group(group, columns)

    def _rows(self, numbers: np.ndarray) -> list[dict]:
        """The phrases of these row numbers, a piece of a file at a time."""
        new = np.array([n for n in numbers.tolist() if n not in self.known], np.int64)
        if len(self.known) + len(new) > KEPT:
            self.known, new = {}, numbers
        group = np.searchsorted(self.first, new, "right") - 1
        for g in np.unique(group):
            file, number, _ = self.groups[g]
            own = new[group == g]
            rows = self._read(file, _PHRASES.names, number).take(own - self.first[g]).to_pylist()
            self.known.update(zip(own.tolist(), rows))
        return [self.known[n] for n in numbers.tolist()]

    def occurring(self, text: str) -> list[dict]:
        """Rows of the phrases that ``text`` holds, and rarely one more."""
        found = [np.zeros(0, np.int64)]
        for a, hashes in _stretches(text, self.longest):
            if a not in self.heads:
                continue
            at = np.flatnonzero(self.heads[a].holds(hashes))
            for n, (begin, end) in ((n, rows) for n, rows in self.by_length.items() if a <= n < 2 * a):
                known = self.keys[begin:end]
                here = at[at + n - a < len(hashes)]
                keys = np.unique(_both(hashes[here], hashes[here + n - a], 0).view(np.int64))
                low, high = np.searchsorted(known, keys), np.searchsorted(known, keys, "right")
                found += [np.arange(begin + i, begin + j) for i, j in zip(low[high > low], high[high > low])]
        return self._rows(np.unique(np.concatenate(found)))


_PHRASES = pa.schema([("phrase", pa.string()), ("document_type", pa.string()), ("ordinal", pa.int32())])


def _index(folder: str) -> _Index:
    if folder not in _BUILT:
        _BUILT.clear()  # another table's
        _BUILT[folder] = _Index(folder)
    return _BUILT[folder]


def _automaton(rows: list[dict]) -> tuple[ahocorasick.Automaton, int]:
    """(automaton, length of the longest phrase) of some phrases."""
    machine, longest = ahocorasick.Automaton(), 0
    for row in rows:
        known = machine.get(row["phrase"], None)
        if known is None or (row["ordinal"], row["document_type"]) < known[1:]:
            machine.add_word(row["phrase"], (len(row["phrase"]), row["ordinal"], row["document_type"]))
            longest = max(longest, len(row["phrase"]))
    if longest:
        machine.make_automaton()
    return machine, longest


def _some(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in runs of about ``SEARCHED`` characters."""
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text or "")
        if held >= SEARCHED:
            yield run
            run, held = [], 0
    if run:
        yield run


def _first(machine: ahocorasick.Automaton, longest: int, text: str | None) -> dict | None:
    if not text or not longest:
        return None
    best = None
    for end, (length, ordinal, kind) in machine.iter(text):
        if best is not None and end - longest + 1 > best[0]:
            break  # what ends here or later begins behind the best
        hit = (end - length + 1, ordinal, kind)
        best = hit if best is None or hit < best else best
    return best and {"at": best[0] + 1, "ordinal": best[1], "type": best[2]}


class PhraseTable:
    """Phrases (phrase, document_type, ordinal) ready to be searched for in tasks.

    Empty and null phrases never occur; of one phrase with several types the least ordinal counts.
    ``shard`` is the number of phrases a file, as long as that gives at most ``FILES`` files.
    """

    def __init__(self, phrases: DataFrame, shard: int = SHARD) -> None:
        rows = phrases.filter("phrase <> ''").select("phrase", "document_type", F.col("ordinal").cast("int").alias("ordinal"))
        self.shards = max(1, min(-(-rows.count() // shard), FILES))
        self.folder = scratch_dir(phrases.sparkSession, "phrases")
        hashed = rows.mapInArrow(_hashed, "phrase string, document_type string, ordinal int, size int, key bigint, head bigint")
        by_hash = hashed.repartitionByRange(self.shards, "size", "key").sortWithinPartitions("size", "key")
        by_hash.write.option("parquet.block.size", GROUP_BYTES).parquet(self.folder)

    def earliest(self, text: Column) -> Column:
        """struct(at, ordinal, type) of the phrase that begins first in ``text``; null when none occurs."""
        folder = self.folder

        def run(texts: pa.Array) -> pa.Array:
            hits, index = [], _index(folder)
            for some in _some(texts.to_pylist()):
                machine, longest = _automaton(index.occurring("\n".join(t for t in some if t)))
                hits += [_first(machine, longest, text) for text in some]
            return pa.array(hits, _ARROW)
        return F.arrow_udf(run, _HIT)(text)
