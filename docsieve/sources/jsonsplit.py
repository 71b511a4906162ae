"""Objects of huge ``{"<member>": [...]}`` files, each file read by many tasks.

A JSON file cannot be cut at line ends: whether a byte range starts inside a string, after a
backslash, or how deep, depends on all bytes before it.  So three steps:

1. Every range is scanned once for each way it can start (outside a string, inside one, inside one
   after a backslash).  What it does is a small transition: how it ends, by how much the depth
   changes, the least depth met, and which root member was opened last.
2. The transitions of a file, a few numbers a range, are composed in order, which gives every range
   its true start.
3. Every range is read again, now knowing its start, and gives the objects that begin in it at depth
   two of the wanted member.  An object that ends in a later range is read to its end.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.sources.remote import read_range

RANGE_BYTES = 8 << 20
_STARTS = ((0, 0), (1, 0), (1, 1))  # (inside a string, after a backslash)
_LOOK_BACK = 4096
_EFFECT = ", ".join(f"{name}{k} bigint" for k in range(len(_STARTS)) for name in ("end", "change", "least", "at_least", "above"))
_OPEN_BRACE, _CLOSE_BRACE, _OPEN, _CLOSE, _QUOTE, _SLASH = (ord(c) for c in "{}[]\"\\")


def structure(data: np.ndarray, in_string: int, escaped: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(positions of brackets outside strings, +1 or -1 for each, inside a string at the end, after a backslash at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), in_string, escaped
    quotes, slashes = np.flatnonzero(data == _QUOTE), np.flatnonzero(data == _SLASH)
    if escaped:  # the first byte means itself
        quotes, slashes = quotes[quotes > 0], slashes[slashes > 0]
    ends_escaped = 0
    if len(slashes):
        first = np.concatenate([[True], np.diff(slashes) > 1])
        run = slashes[first][np.cumsum(first) - 1]
        odd = slashes[(slashes - run) % 2 == 0]  # an odd run up to here: the next byte is escaped
        ends_escaped = int(odd[-1] == len(data) - 1) if len(odd) else 0
        quotes = quotes[~np.isin(quotes, odd + 1)]
    brackets = np.flatnonzero((data == _OPEN_BRACE) | (data == _CLOSE_BRACE) | (data == _OPEN) | (data == _CLOSE))
    brackets = brackets[(np.searchsorted(quotes, brackets) + in_string) % 2 == 0]
    step = np.where((data[brackets] == _OPEN_BRACE) | (data[brackets] == _OPEN), 1, -1)
    return brackets, step, (len(quotes) + in_string) % 2, ends_escaped


def _opens_member(path: str, start: int, data: np.ndarray, at: int, member: bytes) -> bool:
    """The container that opens at ``start + at`` is an array and the value of ``member``."""
    if data[at] != _OPEN:
        return False
    back = _LOOK_BACK
    while True:
        before = data[max(0, at - back): at].tobytes()
        if at < back and start:
            lacking = min(back - at, start)
            before = read_range(path, start - lacking, lacking) + before
        if before.strip() or back > start + at:
            return re.search(rb'(?<!\\)"' + re.escape(member) + rb'"\s*:\s*$', before) is not None
        back *= 16  # nothing but white space so far


def _effect(path: str, start: int, data: np.ndarray, member: bytes, in_string: int, escaped: int) -> tuple[int, int, int, int, int]:
    """(end state, change of depth, least depth, member last opened from the least depth, and from one above).

    Depths are relative to the start.  The root's members open at depth one, which is the least
    depth of the range or one above it, or the range opens none.  -1: none opened; 1: the wanted one.
    """
    at, step, ends_in, ends_escaped = structure(data, in_string, escaped)
    after = np.cumsum(step)
    least = int(min(0, after.min(initial=0)))
    opened = []
    for level in (least, least + 1):
        hits = np.flatnonzero((step > 0) & (after - 1 == level))
        opened.append(int(_opens_member(path, start, data, int(at[hits[-1]]), member)) if len(hits) else -1)
    return ends_in + ends_escaped if ends_in else 0, int(step.sum()), least, *opened


def _effects(member: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(read_range(row["path"], row["start"], row["size"]), np.uint8)
                effects = [int(x) for state in _STARTS for x in _effect(row["path"], row["start"], data, member, *state)]
                yield pa.RecordBatch.from_pylist([{**row, **dict(zip([c.split()[0] for c in _EFFECT.split(", ")], effects, strict=True))}])
    return run


def _composed(ranges: pd.DataFrame) -> pd.DataFrame:
    """The true start of every range of a file: (state, depth, inside the wanted member)."""
    ranges = ranges.sort_values("start")
    state, depth, wanted, out = 0, 0, 0, []
    for row in ranges.to_dict("records"):
        out.append((row["path"], row["start"], row["size"], state, depth, wanted))
        floor = depth + row[f"least{state}"]
        opened = row[f"above{state}"] if floor == 0 else row[f"at_least{state}"] if floor == 1 else -1
        wanted = wanted if opened < 0 else opened
        depth += row[f"change{state}"]
        state = row[f"end{state}"]
    return pd.DataFrame(out, columns=["path", "start", "size", "state", "depth", "wanted"])


def _rest(path: str, at: int, in_string: int, escaped: int, depth: int) -> bytes:
    """Bytes from ``at`` up to where the depth falls back to two; nothing if the file ends first."""
    got, size = [], 1 << 16
    while piece := read_range(path, at, size):
        data = np.frombuffer(piece, np.uint8)
        brackets, step, in_string, escaped = structure(data, in_string, escaped)
        after = depth + np.cumsum(step)
        ends = np.flatnonzero((after == 2) & (step < 0))
        if len(ends):
            return b"".join([*got, piece[: int(brackets[ends[0]]) + 1]])
        got.append(piece)
        depth = int(after[-1]) if len(after) else depth
        at, size = at + len(piece), min(size * 4, RANGE_BYTES)
    return b""


def _objects(member: bytes) -> Callable:
    def found(row: dict) -> Iterator[tuple[int, bytes]]:
        path, start = row["path"], row["start"]
        raw = read_range(path, start, row["size"])
        data = np.frombuffer(raw, np.uint8)
        at, step, ends_in, ends_escaped = structure(data, *_STARTS[row["state"]])
        after = row["depth"] + np.cumsum(step)
        roots = np.flatnonzero((step > 0) & (after == 2))
        wanted = [row["wanted"]] + [int(_opens_member(path, start, data, int(at[i]), member)) for i in roots]
        begins = np.flatnonzero((after == 3) & (data[at] == _OPEN_BRACE) & (step > 0))
        ends = np.flatnonzero((after == 2) & (step < 0))
        for i in begins:
            if not wanted[int(np.searchsorted(roots, i))]:
                continue
            k = int(np.searchsorted(ends, i))
            if k < len(ends):
                yield int(at[i]), raw[int(at[i]): int(at[ends[k]]) + 1]
            elif rest := _rest(path, start + len(raw), ends_in, ends_escaped, int(after[-1])):
                yield int(at[i]), raw[int(at[i]):] + rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                some, held = [], 0
                for at, text in found(row):
                    some.append({"path": row["path"], "pos": row["start"] + at, "text": text.decode("utf-8", "replace")})
                    held += len(text)
                    if held > RANGE_BYTES:
                        yield pa.RecordBatch.from_pylist(some, _FOUND)
                        some, held = [], 0
                if some:
                    yield pa.RecordBatch.from_pylist(some, _FOUND)
    return run


_FOUND = pa.schema([("path", pa.string()), ("pos", pa.int64()), ("text", pa.string())])


def reading_tasks(ranges: int, size: int, cores: int) -> int:
    """A task per ``RANGE_BYTES`` or four per core, whichever is more; none without a range."""
    return max(1, min(ranges, max(-(-size // RANGE_BYTES), 4 * cores), 100_000))


def member_objects(files: DataFrame, member: str, range_bytes: int = RANGE_BYTES, tasks: int | None = None) -> DataFrame:
    """Objects of the array ``member`` of each file's root object: path, pos (byte position), text.

    ``files`` has source_path and file_size_bytes.  Files are UTF-8, a byte order mark is skipped;
    elements that are no objects, members of other names and files whose root is no object give no
    rows, and of a file that breaks off its complete objects remain.  ``tasks`` is the number of
    tasks that read; unless given, small ranges share a task, so it follows the bytes and not the ranges.
    """
    sized = files.filter("file_size_bytes > 0").select("source_path", "file_size_bytes")
    if tasks is None:
        total, size = sized.agg(F.sum(F.expr(f"(file_size_bytes + {range_bytes - 1}) div {range_bytes}")), F.sum("file_size_bytes")).first()
        tasks = reading_tasks(int(total or 0), int(size or 0), files.sparkSession.sparkContext.defaultParallelism)
    ranges = sized.select(F.col("source_path").alias("path"), "file_size_bytes", F.explode(F.expr(f"sequence(0L, file_size_bytes - 1, {range_bytes}L)")).alias("start")).select(
        "path", "start", F.least(F.lit(range_bytes), F.col("file_size_bytes") - F.col("start")).cast("bigint").alias("size"))
    effects = ranges.repartition(tasks).mapInArrow(_effects(member.encode()), f"path string, start bigint, size bigint, {_EFFECT}")
    starts = effects.groupBy("path").applyInPandas(_composed, "path string, start bigint, size bigint, state int, depth int, wanted int")
    return starts.repartition(tasks).mapInArrow(_objects(member.encode()), "path string, pos bigint, text string")
