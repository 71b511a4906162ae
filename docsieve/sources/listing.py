"""The inventory of document files as a Spark data source.

``document_files`` lists a folder, names starting with ``_`` or ``.`` included, which Spark's own
file sources hide.  A file's contents are no column; with ``headBytes`` that many leading bytes are
fetched by a range read, so a file of any size costs those bytes.  Filters on path, size and time
are applied to the listing, before any file is opened.

The driver lists folders until it knows ``folders`` of them.  Files met so far are dealt into
partitions of at most ``files`` files and ``bytes`` bytes, and every folder left is a partition
whose task lists it, so a deep tree is listed in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import datasource as ds

from docsieve.sources.remote import named, opened, read_range

SCHEMA = "source_path string, file_size_bytes bigint, modified_at timestamp, head string"
_ARROW = pa.schema([("source_path", pa.string()), ("file_size_bytes", pa.int64()), ("modified_at", pa.timestamp("us", "UTC")), ("head", pa.string())])
_TESTS: dict[type, Callable] = {
    ds.EqualTo: lambda x, v: x == v,
    ds.GreaterThan: lambda x, v: x > v,
    ds.GreaterThanOrEqual: lambda x, v: x >= v,
    ds.LessThan: lambda x, v: x < v,
    ds.LessThanOrEqual: lambda x, v: x <= v,
    ds.In: lambda x, v: x in v,
    ds.StringStartsWith: lambda x, v: x.startswith(v),
    ds.StringEndsWith: lambda x, v: x.endswith(v),
    ds.StringContains: lambda x, v: v in x,
}
_BATCH = 4096


@dataclass
class FilesPart(ds.InputPartition):
    """Listed files (path, size, time), or a folder still to be listed."""

    files: tuple = ()
    folder: str | None = None


def _listed(system: fs.FileSystem, folder: str, recursive: bool) -> tuple[list, list[str]]:
    infos = system.get_file_info(fs.FileSelector(folder, recursive=recursive, allow_not_found=True))
    found = [(i.path, i.size, i.mtime) for i in infos if i.type == fs.FileType.File]
    return found, [i.path for i in infos if i.type == fs.FileType.Directory]


class DocumentFilesReader(ds.DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.head_bytes = int(options.get("headBytes", 0))
        self.most_folders = int(options.get("folders", 256))
        self.most_files = int(options.get("files", 10_000))
        self.most_bytes = int(options.get("bytes", 1 << 40))
        self.tests: list[tuple[int, Callable, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        columns = {"source_path": 0, "file_size_bytes": 1}
        for wanted in filters:
            test, column = _TESTS.get(type(wanted)), columns.get(".".join(getattr(wanted, "attribute", ())))
            if isinstance(wanted, ds.IsNotNull) and column is not None:
                continue  # neither is ever null
            if test is None or column is None:
                yield wanted
            else:
                self.tests.append((column, test, wanted.value))

    def partitions(self) -> list[FilesPart]:
        system, root = opened(self.root)
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            return [FilesPart(files=((info.path, info.size, info.mtime),))]
        folders, files, expanded = [root], [], 0
        while folders and expanded < self.most_folders:
            own, below = _listed(system, folders.pop(0), recursive=False)
            files += self._kept(own)
            folders += below
            expanded += 1
        parts, held, size = [], [], 0
        for file in files:
            if held and (len(held) >= self.most_files or size + file[1] > self.most_bytes):
                parts.append(FilesPart(files=tuple(held)))
                held, size = [], 0
            held.append(file)
            size += file[1]
        return parts + [FilesPart(files=tuple(held))] * bool(held) + [FilesPart(folder=folder) for folder in folders] or [FilesPart()]

    def _kept(self, files: list) -> list:
        if not self.tests:
            return files
        row = lambda f: (named(self.root, f[0]), f[1])
        return [f for f in files if all(test(row(f)[column], value) for column, test, value in self.tests)]

    def _head(self, path: str) -> str | None:
        """Leading bytes in hexadecimal; null for a file that went or cannot be opened."""
        if not self.head_bytes:
            return None
        try:
            return read_range(path, 0, self.head_bytes).hex().upper()
        except OSError:
            return None

    def read(self, partition: FilesPart) -> Iterator[pa.RecordBatch]:
        files = partition.files
        if partition.folder is not None:
            files = self._kept(_listed(opened(self.root)[0], partition.folder, recursive=True)[0])
        for first in range(0, len(files), _BATCH):
            some = files[first: first + _BATCH]
            paths = [named(self.root, path) for path, _, _ in some]
            yield pa.RecordBatch.from_arrays([
                pa.array(paths, pa.string()), pa.array([size for _, size, _ in some], pa.int64()),
                pa.array([time for _, _, time in some], pa.timestamp("us", "UTC")), pa.array([self._head(path) for path in paths], pa.string())], schema=_ARROW)


class DocumentFiles(ds.DataSource):
    """``spark.read.format("document_files").option("headBytes", 8).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocumentFilesReader:
        return DocumentFilesReader(self.options)
