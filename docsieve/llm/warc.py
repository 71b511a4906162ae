"""WARC archives with a two-level capture index.

Tasks write pages as gzip members, one a record, into archive files of the shared folder.
The index has a line per capture, keyed by its URL with reversed host.  Lines are sorted by
range partitions and written as blocks, each compressed alone; a sparse directory keeps the
first key, file, offset and length of every block.  A lookup searches the directory, reads
one range of an index file, searches its lines and reads one range of an archive.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import new_path, written

BLOCK_LINES = 500
DATE = "2024-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """Sort key of a URL: host labels reversed and joined by commas, then path and query, lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return url.lower()
    if host.startswith("www."):
        host = host[4:]
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}{port}){rest}".lower()


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_text(value: str) -> bytes:
    """A header value: control characters (a URL may hold any) as percent escapes."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value).encode("utf-8", "surrogatepass")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header and drops the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:page:%s>" % (b"" if page_id is None else str(page_id).encode()),
        b"WARC-Date: " + DATE.encode(), b"WARC-Payload-Digest: sha1:" + payload_digest(payload).encode(),
    ]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _header_text(url))
    if revisit:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 b"WARC-Refers-To: <urn:page:%s>" % str(refers_to).encode()]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of a record; raises ValueError if lengths or digest do not agree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != b"WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(line.split(b": ", 1) for line in lines[1:])
    length = int(fields[b"Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("record length does not agree")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
    kind = fields[b"WARC-Type"].decode()
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("payload does not agree with its header")

    def page(name: bytes) -> int | None:
        value = fields.get(name, b"").removeprefix(b"<urn:page:").removesuffix(b">")
        return int(value) if value else None

    url = fields.get(b"WARC-Target-URI")
    return {"page_id": page(b"WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
            "refers_to": page(b"WARC-Refers-To"), "url": None if url is None else url.decode("utf-8", "surrogatepass"),
            "payload": payload if kind == "response" else None}


def _commit(folder: str, suffix: str, parts: Iterator[tuple[bytes, tuple]]) -> Iterator[tuple[str, int, int, tuple]]:
    """Write parts into a new file of the folder; yields (file, offset, length, what) after closing.

    The name is new for every attempt: a task that is repeated leaves a file that no index names.
    """
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    at, placed = 0, []
    with store.open_output_stream(f"{root}/{name}", compression=None) as out:
        for data, what in parts:
            out.write(data)
            placed.append((name, at, len(data), what))
            at += len(data)
    yield from placed


def _gzip(data: bytes) -> bytes:
    return gzip.compress(data, compresslevel=3, mtime=0)


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write all pages; returns the captures (surt, page_id, file, offset, length).

    Of pages with equal payloads of at least ``least`` bytes the largest page_id (null only if
    all are) is a response, the others revisit it.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # payload identity: SHA-1, the digest that the archive states, with SHA-256 behind it
    keyed = own.select("page_id", F.concat(F.sha1("html"), F.sha2("html", 256)).alias("digest"), F.octet_length("html").alias("size"))
    groups = keyed.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1")
    later = written(keyed.join(groups, "digest").filter(F.col("size") >= least).filter(~F.col("page_id").eqNullSafe(F.col("keep"))).select(
        F.col("page_id").alias("r_page"), F.substring("digest", 1, 40).alias("r_sha"), F.col("keep").alias("refers_to")).distinct(), "revisits")
    decided = own.join(later, own.page_id.eqNullSafe(later.r_page) & (F.sha1(own.html) == later.r_sha), "left").select(
        "page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple[bytes, tuple]]:
            for batch in batches:
                columns = [batch.column(i) for i in range(4)]
                for i in range(batch.num_rows):
                    page_id, url, html, refers_to = (c[i].as_py() for c in columns)
                    data = record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, refers_to is not None)
                    yield _gzip(data), (surt(url), page_id)

        batch: list[tuple] = []
        for name, at, length, (key, page_id) in _commit(folder, ".warc.gz", records()):
            batch.append((key, page_id, name, at, length))
        for first in range(0, len(batch), 10_000):
            yield _table(batch[first: first + 10_000], ["surt", "page_id", "file", "offset", "length"],
                         (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))

    return written(decided.mapInArrow(run, "surt string, page_id long, file string, offset long, length long"), "captures")


def _table(rows: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * len(names), kinds)], names=names)


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort captures by key, write them as compressed blocks; returns the block directory.

    Directory: first_key, last_key, file, offset, length, lines.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple[bytes, tuple]]:
            lines: list[str] = []

            def flush() -> tuple[bytes, tuple]:
                first, last = json.loads(lines[0])[0], json.loads(lines[-1])[0]
                out = _gzip("\n".join(lines).encode()), (first, last, len(lines))
                lines.clear()
                return out

            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    lines.append(json.dumps(row))
                    if len(lines) >= block_lines:
                        yield flush()
            if lines:
                yield flush()

        rows = [(first, last, name, at, length, n) for name, at, length, (first, last, n) in _commit(folder, ".cdx.gz", blocks())]
        yield _table(rows, ["first_key", "last_key", "file", "offset", "length", "lines"],
                     (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))

    ordered = captures.repartitionByRange("surt", "page_id").sortWithinPartitions("surt", "page_id")
    return written(ordered.mapInArrow(run, "first_key string, last_key string, file string, offset long, length long, lines long"), "directory")


class Reader:
    """Range reads of the files of one folder; keeps the file in use open."""

    def __init__(self, folder: str) -> None:
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.store.open_input_file(f"{self.root}/{name}")
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.name = self.file = None


def index_lines(reader: Reader, file: str, offset: int, length: int) -> list[list]:
    return [json.loads(line) for line in gzip.decompress(reader.read(file, offset, length)).decode().split("\n")]


FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _records(reader: Reader, lines: list[list]) -> list[dict]:
    """Records of index lines, read file by file in order of offset."""
    return [parse_record(zlib.decompress(reader.read(file, at, length), 31)) for _, _, file, at, length in sorted(lines, key=lambda x: (x[2], x[3]))]


def read_archives(directory: DataFrame, folder: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """All records, by way of the index: each task reads blocks of it and the ranges they name."""
    wanted, schema, kinds = _wanted(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = _records(reader, index_lines(reader, file, offset, length))
                yield _table([tuple(r[c] for c in wanted) for r in found], wanted, kinds)
        reader.close()

    blocks = directory.select("file", "offset", "length")
    return blocks.repartition(directory.sparkSession.sparkContext.defaultParallelism * 4, "file", "offset").mapInArrow(run, schema)


def _blocks_of(directory: str) -> Callable:
    """Sorted keys to the index blocks that may hold them: (file, offset, length, keys).

    A task reads the part of the directory that its keys lie in and bisects it; a key that fills
    many blocks is a row for each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(directory)
        table = dataset.dataset(root, filesystem=store, format="parquet")
        columns = ["first_key", "last_key", "file", "offset", "length"]
        for batch in batches:
            keys = batch.column(0).to_pylist()
            if not keys:
                continue
            near = table.to_table(columns, filter=(dataset.field("last_key") >= keys[0]) & (dataset.field("first_key") <= keys[-1]))
            blocks = sorted(zip(*(near[c].to_pylist() for c in columns)))
            first, last = [b[0] for b in blocks], [b[1] for b in blocks]
            found: dict[int, list[str]] = {}
            for key in keys:
                # neither first nor last keys ever fall from block to block
                for i in range(bisect.bisect_left(last, key), bisect.bisect_right(first, key)):
                    found.setdefault(i, []).append(key)
            yield _table([(*blocks[i][2:], own) for i, own in found.items()], ["file", "offset", "length", "keys"],
                         (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())))
    return run


def _surts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column(0).to_pylist()], pa.string())], ["surt"])


def lookup_urls(urls: DataFrame, directory: DataFrame, folder: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """Records of all captures of the URLs in column ``url``, found through the two levels of the index.

    Keys, sorted, are bisected in the directory; each block that may hold some is read once more
    by whoever owns it, its lines are bisected, and the ranges they name are read.  A URL with very
    many captures is spread over its blocks.  ``directory`` is the table that ``write_index`` made.
    Repeated URLs and such with one key count once, a null URL has the key of the empty one, and a
    URL without a capture gives no row.
    """
    wanted, schema, kinds = _wanted(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            for file, offset, length, keys in zip(*(batch.column(i).to_pylist() for i in range(4))):
                lines = index_lines(reader, file, offset, length)
                at = [line[0] for line in lines]
                hits = [line for key in keys for line in lines[bisect.bisect_left(at, key): bisect.bisect_right(at, key)]]
                for first in range(0, len(hits), BLOCK_LINES):
                    yield _table([tuple(r[c] for c in wanted) for r in _records(reader, hits[first: first + BLOCK_LINES])], wanted, kinds)
        reader.close()

    keys = urls.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(_surts, "surt string").distinct()
    blocks = keys.repartitionByRange("surt").sortWithinPartitions("surt").mapInArrow(
        _blocks_of(directory._llm_path), "file string, offset long, length long, keys array<string>")
    return blocks.repartition(urls.sparkSession.sparkContext.defaultParallelism * 4, "file", "offset").mapInArrow(run, schema)


def _wanted(columns: tuple[str, ...]) -> tuple[list[str], str, tuple]:
    wanted = [c for c in (x.split()[0] for x in FIELDS.split(", ")) if not columns or c in columns]
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
             "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    return wanted, ", ".join(x for x in FIELDS.split(", ") if x.split()[0] in wanted), tuple(kinds[c] for c in wanted)


def warc_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages to archives, look all their URLs up again: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is the empty payload, null url a record without target; rows repeated with one
    page_id and payload are responses all, as none is larger than another.  Null ids revisit
    the id that stays.  Very long pages are records like any other, held in memory one at a
    time.  Other columns are ignored; an empty table gives no rows.
    """
    folder = new_path(pages.sparkSession, "warc")
    directory = write_index(write_archives(pages, folder, least), folder)
    return lookup_urls(pages.select("url"), directory, folder, ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
