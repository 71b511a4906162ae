"""Shared folder, written tables and byte-level text arrays used by the operators of this package."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session settings while a table of the shared folder is written: shuffle files go with the write,
#: and Arrow batches hold at most 16 MB of texts.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that names none (a test) gets a temporary one of its own; on a cluster
    a folder of one machine would hold parts of a table, so a missing setting is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not getattr(context, "_llm_dir", None):
        context._llm_dir = "file://" + tempfile.mkdtemp(prefix="docsieve-llm-")
    return context._llm_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docsieve-llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **settings: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost nothing.

    The shuffle files behind the write are of no further use and are removed with it.  ``settings``
    hold during the write only.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = {key: spark.conf.get(key) for key in WRITING | settings}
    for key, value in (WRITING | settings).items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    table = spark.read.schema(df.schema).parquet(path)
    table._llm_path = path
    return table


def forget(table: DataFrame) -> None:
    """Remove the files of a table that ``written`` made, once a later one has taken its place."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._llm_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def one_text(name: str) -> F.Column:
    """Of a group's texts the one with the least hash; partial aggregation leaves one a task, so no group is hot."""
    return F.min(F.struct(F.xxhash64(name).alias("h"), F.col(name).alias("t")))["t"].alias(name)


# ---- texts as byte arrays ------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 1 << 16)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, _BASE)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, inverse)]), dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash: ``out[i]`` covers ``data[:i]`` (see ``span_hash``)."""
    up, _ = _POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        values = _TABLE[data] if data.dtype == np.uint8 else mix(data) | np.uint64(1)
        np.cumsum(values * up[: len(data)], out=out[1:], dtype=np.uint64)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ``data[start:end]`` that depend on the content alone."""
    _, down = _POWERS.get(len(prefix))
    with np.errstate(over="ignore"):
        raw = (prefix[end] - prefix[start]) * down[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as (bytes, offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset: column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def text_blocks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``limit`` bytes: (first, end, bytes, offsets from 0).

    A longer text is a run of its own, whole.
    """
    data, offsets = byte_column(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first]: offsets[end]], offsets[first: end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a run: (start, end, row) of each."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, ~solid[:-1]
    after[-1], after[:-1] = True, ~solid[1:]
    start = np.flatnonzero(solid & (before | edge[:-1]))
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def counts_of(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, first index) per row of a sorted row index."""
    number = np.bincount(row, minlength=n).astype(np.int64)
    return number, np.concatenate([[0], np.cumsum(number)]).astype(np.int64)
