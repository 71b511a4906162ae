"""Repeated byte strings, by suffix sorting what may repeat.

Every string of ``window`` bytes has a minimizer, so equal strings lie in pieces with one
minimizer (see ``windows``).  Pieces with equal bytes repeat as a whole.  Of the others only
those can hold a repeat that share, around the minimizer, one of eight blocks of 350 bytes,
and only in the windows that hold a shared block; every window holds one.  One piece of each
content is fetched, and the suffixes that start at these windows are sorted together with
those of the same minimizer.

The sort is a mergesort on hashes: prefix polynomial hashes give the hash of any stretch in
one step, a binary search over them finds the common extension of two suffixes, and the byte
behind it decides (suffixes that differ in their first eight bytes need no search).
Neighbours that agree in a whole window are compared byte by byte before they count.  All
merges of a level run at once in numpy.

A minimizer met by very many contents is dealt over several sorts, each of which leaves one
digest per window; the digests meet in a Spark aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import prefix_hash, span_hash, text_blocks, written
from docsieve.llm.windows import pieces

WINDOW, GRAM, STEP = 400, 32, 50
RUN = 4096  # contents of one minimizer that are sorted together
SORT_BYTES = 200_000  # small groups are sorted together up to about this size
PIECE = "mini long, piece long, doc long, pos long, n int, anchor int, blocks array<struct<j: int, block: long>>"


def _minis(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(pieces(prefix_hash(data), offsets, window, GRAM).key.view(np.int64))], names=["mini"])
    return run


def _pieces(window: int):
    """Pieces with the hashes of the blocks around the minimizer that one of their windows holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for begin, end, data, offsets in text_blocks(batch.column(1)):
                prefix = prefix_hash(data)
                p = pieces(prefix, offsets, window, GRAM)
                low, high = offsets[p.row] + p.start, offsets[p.row] + p.start + p.count - 1  # first and last window
                index, js, values = [], [], []
                for j in range(window // STEP):
                    # a window that starts i bytes before the minimizer holds block j if
                    # window - STEP * (j + 1) <= i <= window - STEP * j
                    a = p.anchor - (window - STEP * (j + 1))
                    some = np.flatnonzero((p.anchor - high <= window - STEP * j) & (p.anchor - low >= window - STEP * (j + 1)))
                    index.append(some)
                    js.append(np.full(len(some), j, np.int32))
                    values.append(span_hash(prefix, a[some], a[some] + window - STEP))
                index = np.concatenate(index)
                order = np.argsort(index, kind="stable")
                number = np.bincount(index, minlength=len(p.row))
                blocks = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(number)]), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(np.concatenate(js)[order]), pa.array(np.concatenate(values)[order].view(np.int64))], ["j", "block"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.key.view(np.int64)), pa.array(p.content.view(np.int64)), pa.array(doc[begin:end][p.row]), pa.array(p.start),
                     pa.array(p.count.astype(np.int32)), pa.array((p.anchor - low).astype(np.int32)), blocks],
                    names=["mini", "piece", "doc", "pos", "n", "anchor", "blocks"])
    return run


def _listed(listed: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    row = np.repeat(np.arange(len(listed)), np.asarray(listed.value_lengths().fill_null(0)))
    flat = listed.flatten()
    return row, [np.asarray(flat.field(i)).astype(np.int64) for i in range(len(names))]


def _contents(window: int):
    """Bytes of the pieces listed per document; a place with other bytes is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in text_blocks(batch.column(1)):
                row, (pos, n, mini, piece, anchor, js) = _listed(
                    batch.column(2).slice(begin, end - begin), ("pos", "n", "mini", "piece", "anchor", "js"))
                a = offsets[row] + pos
                b = a + n + window - 1
                inside = b <= offsets[row + 1]
                a, b, mini, piece, anchor, js = a[inside], b[inside], mini[inside], piece[inside], anchor[inside], js[inside]
                true = np.flatnonzero(span_hash(prefix_hash(data), a, b).view(np.int64) == piece)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mini[true]), pa.array(piece[true]), pa.array(anchor[true].astype(np.int32)), pa.array(js[true]),
                     pa.array([data[a[i]: b[i]].tobytes() for i in true], pa.binary())], names=["mini", "piece", "anchor", "js", "bytes"])
    return run


def wanted_windows(anchor: int, js: int, count: int, window: int) -> np.ndarray:
    """Windows of a piece, from its start, that hold one of the blocks in the bit set ``js``."""
    before = anchor - np.arange(count)  # bytes from the window's start to the minimizer
    out = np.zeros(count, bool)
    for j in range(window // STEP):
        if js >> j & 1:
            out |= (before >= window - STEP * (j + 1)) & (before <= window - STEP * j)
    return np.flatnonzero(out)


# ---- suffix sort ------------------------------------------------------------------------

def _extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Common extension of the suffixes at a and b, up to ``limit``, by binary search on hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), limit, np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) >> 1
        same = span_hash(prefix, a, a + mid) == span_hash(prefix, b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)


class _Suffixes:
    """Suffixes at ``start``, compared on their first ``limit`` bytes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, limit: int) -> None:
        self.data, self.start, self.limit, self.prefix = data, start, limit, prefix_hash(data)
        self.whole = span_hash(self.prefix, start, start + limit)
        self.head = np.zeros(len(start), np.uint64)  # the first eight bytes as a number
        for k in range(8):
            self.head = (self.head << np.uint64(8)) | (data[start + k].astype(np.uint64) if k < limit else np.uint64(0))

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix a sorts before, like or after suffix b."""
        x, y = self.head[a], self.head[b]
        out = np.where(x > y, 1, -1)
        tie = np.flatnonzero(x == y)
        same = self.whole[a[tie]] == self.whole[b[tie]]
        out[tie[same]] = 0
        tie = tie[~same]
        p, q = self.start[a[tie]], self.start[b[tie]]
        at = np.minimum(_extension(self.prefix, p, q, self.limit), self.limit - 1)
        out[tie] = np.sign(self.data[p + at].astype(np.int64) - self.data[q + at])
        return out


def sorted_suffixes(suffixes: _Suffixes, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes within each group; groups are contiguous.

    Bottom-up mergesort: at each level every element finds its rank in the neighbouring run by
    binary search, all elements at once.
    """
    n = len(group)
    order = np.arange(n)
    bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    base = bounds[np.searchsorted(bounds, np.arange(n), "right") - 1]  # first place of the own group
    ends = np.append(bounds[1:], n)
    stop = ends[np.searchsorted(bounds, np.arange(n), "right") - 1]
    largest = int((ends - bounds).max()) if n else 0
    width = 1
    while width < largest:
        place = np.arange(n)
        run = (place - base) // width
        first = base + run * width  # own run
        left = run % 2 == 0
        other = np.minimum(np.where(left, first + width, first - width), stop)
        other_end = np.minimum(other + width, stop)
        low, high = other.copy(), other_end.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            sign = suffixes.after(order[open_], order[mid])
            # an element goes behind those of the other run that are less, a right one also behind equals
            behind = (sign > 0) | ((sign == 0) & ~left[open_])
            low[open_], high[open_] = np.where(behind, mid + 1, low[open_]), np.where(behind, high[open_], mid)
        merged = np.where(left, first, other) + (place - first) + (low - other)
        after = np.empty(n, np.int64)
        after[merged] = order
        order = after
        width *= 2
    return order


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    out, view = np.zeros(len(a), bool), np.lib.stride_tricks.sliding_window_view(data, length)
    for i in range(0, len(a), 4096):
        out[i: i + 4096] = (view[a[i: i + 4096]] == view[b[i: i + 4096]]).all(1)
    return out


def repeated_starts(contents: list[tuple[int, bytes, np.ndarray]], window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For pieces (group, bytes, windows), in order of group: which of the windows repeat in the group.

    Also which windows are the first of their kind in the sort.
    """
    data = np.frombuffer(b"".join(b for _, b, _ in contents), np.uint8)
    sizes, counts = np.array([len(b) for _, b, _ in contents]), np.array([len(w) for *_, w in contents])
    begin, each = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(contents)), counts)
    start = begin[each] + np.concatenate([w for *_, w in contents])
    group = np.array([g for g, *_ in contents])[each]
    suffixes = _Suffixes(data, start, window)
    order = sorted_suffixes(suffixes, group)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((group[a] == group[b]) & (suffixes.whole[a] == suffixes.whole[b]))
    near = near[_equal_bytes(data, start[a[near]], start[b[near]], window)] if len(near) else near
    found, first = np.zeros(len(start), bool), np.ones(len(start), bool)
    found[order[near]] = found[order[near + 1]] = True
    first[order[near + 1]] = False
    edges = np.cumsum(counts)[:-1]
    return list(zip(np.split(found, edges), np.split(first, edges)))


def _sort_task(window: int):
    """Rows sorted by (mini, run): sort the suffixes of each group.

    Gives the windows that repeat as (mini, piece, at, n, digest null), and for groups dealt
    over several runs the digest of the first window of each kind.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (group, piece, bytes, windows, runs)
        size, seen, last = 0, set(), None

        def flush() -> pa.RecordBatch:
            names = {g: i for i, g in enumerate(dict.fromkeys(h[0] for h in held))}
            rows: list[tuple] = []
            for ((mini, _), piece, raw, at, runs), (found, first) in zip(held, repeated_starts([(names[h[0]], h[2], h[3]) for h in held], window)):
                marks = np.zeros(len(raw) + 1, np.int8)
                marks[at[found]] = 1
                edge = np.flatnonzero(np.diff(np.concatenate([[0], marks])))
                rows += [(mini, piece, int(a), int(b - a), None) for a, b in zip(edge[::2], edge[1::2])]
                if runs > 1:
                    rows += [(mini, piece, int(i), 1, hashlib.blake2b(raw[i: i + window], digest_size=16).digest()) for i in at[first]]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                names=["mini", "piece", "at", "n", "digest"])

        for batch in batches:
            for mini, salt, runs, piece, anchor, js, raw in zip(*(batch.column(i).to_pylist() for i in range(7))):
                group = (mini, salt)
                if group != last:
                    if size > SORT_BYTES:
                        yield flush()
                        size = 0
                    seen, last = set(), group
                at = wanted_windows(anchor, js, len(raw) - window + 1, window)
                if piece not in seen and len(at):
                    seen.add(piece)
                    held.append((group, piece, raw, at, runs))
                    size += len(raw)
        if held:
            yield flush()
    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for begin, end, data, offsets in text_blocks(batch.column(1)):
                cover = np.zeros(len(data) + 1, np.int64)
                row, (pos, n, piece_pos, piece_n, piece) = _listed(
                    batch.column(2).slice(begin, end - begin), ("pos", "n", "piece_pos", "piece_n", "piece"))
                if len(row):
                    # the piece that the span lies in must have its bytes at its place
                    a = offsets[row] + piece_pos
                    b = a + piece_n + window - 1
                    ok = b <= offsets[row + 1]
                    ok[ok] = span_hash(prefix_hash(data), a[ok], b[ok]).view(np.int64) == piece[ok]
                    low = offsets[row[ok]] + pos[ok]
                    np.add.at(cover, low, 1)
                    np.add.at(cover, low + n[ok] + window - 1, -1)
                gone = np.cumsum(cover[:-1]) > 0
                for i in range(end - begin):
                    own = gone[offsets[i]: offsets[i + 1]]
                    kept = data[offsets[i]: offsets[i + 1]][~own].tobytes()
                    spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
                    out.append((len(own), len(own) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def repeated_strings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document key, the spans (pos, n, piece_pos, piece_n, piece) of windows that occur elsewhere too."""
    own = docs.select("doc", "text")
    minis = written(own.select("text").mapInArrow(_minis(window), "mini long").groupBy("mini").agg(
        F.count("*").alias("m")).filter("m > 1").select("mini"), "shared-minimizers")
    found = written(own.mapInArrow(_pieces(window), PIECE).join(minis, "mini"), "pieces")
    contents = found.groupBy("mini", "piece").agg(F.count("*").alias("m"), F.min(F.struct("doc", "pos", "n", "anchor")).alias("first"))
    contents = written(contents, "contents")
    many = contents.filter("m > 1").select("mini", "piece")
    whole = found.join(many, ["mini", "piece"], "left_semi").select("doc", "pos", "n", F.col("pos").alias("piece_pos"), F.col("n").alias("piece_n"), "piece")

    # pieces that share a block with another content of their minimizer
    blocks = found.select("mini", "piece", F.explode("blocks").alias("b")).select("mini", "piece", "b.j", "b.block").distinct()
    shared = blocks.groupBy("mini", "j", "block").agg(F.count("*").alias("m")).filter("m > 1").select("mini", "j", "block")
    candidates = blocks.join(shared, ["mini", "j", "block"], "left_semi").groupBy("mini", "piece").agg(
        F.bit_or(F.expr("shiftleft(1L, j)")).alias("js"))
    fetched = contents.join(candidates, ["mini", "piece"]).select("mini", "piece", "js", "first.*")
    listed = fetched.groupBy("doc").agg(F.collect_list(F.struct("pos", "n", "mini", "piece", "anchor", "js")).alias("wanted"))
    raw = written(own.join(listed, "doc").select("doc", "text", "wanted").mapInArrow(
        _contents(window), "mini long, piece long, anchor int, js long, bytes binary"), "contents-bytes")
    runs = raw.groupBy("mini").agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs"))
    dealt = raw.join(runs, "mini").withColumn("run", F.pmod(F.xxhash64("piece"), F.col("runs")).cast("int"))
    marks = written(dealt.select("mini", "run", "runs", "piece", "anchor", "js", "bytes").repartition("mini", "run").sortWithinPartitions("mini", "run", "piece").mapInArrow(
        _sort_task(window), "mini long, piece long, at int, n int, digest binary"), "marks")
    met = marks.filter("digest is not null")
    across = met.join(met.groupBy("mini", "digest").agg(F.count("*").alias("m")).filter("m > 1"), ["mini", "digest"], "left_semi")
    part = marks.filter("digest is null").unionByName(across).select("mini", "piece", "at", F.col("n").alias("len"))
    places = found.join(many, ["mini", "piece"], "left_anti")
    partial = places.join(part, ["mini", "piece"]).select(
        "doc", (F.col("pos") + F.col("at")).alias("pos"), F.col("len").alias("n"), F.col("pos").alias("piece_pos"), F.col("n").alias("piece_n"), "piece")
    return written(whole.unionByName(partial).groupBy("doc").agg(
        F.collect_list(F.struct("pos", "n", "piece_pos", "piece_n", "piece")).alias("spans")), "spans")


def remove_repeated_strings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    A byte of the UTF-8 text goes if a string of ``window`` bytes that covers it also starts
    anywhere else, in this document or another; all occurrences go.  Null counts as empty;
    texts shorter than the window lose nothing.  Repeated rows are occurrences of their own,
    so their strings go; ids may be null.  Very long texts are read in pieces that overlap by a
    window, whole.  Other columns are ignored; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("doc", F.coalesce("doc_id", F.xxhash64("text")))
    spans = repeated_strings(own, window)
    return own.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(
        _remove(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
