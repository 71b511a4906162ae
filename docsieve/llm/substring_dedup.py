"""Word passages repeated from earlier documents, by compacting a de Bruijn graph.

Windows of k words are the edges of a de Bruijn graph over (k - 1)-word nodes.  The graph is
never built edge by edge: each document is read as paths, runs of consecutive edges around
one minimizer.  A path whose minimizer no other document has is dropped first.  Paths with
the same words are one path of the graph with many occurrences (one join finds them all);
where paths through a minimizer differ they branch, and only there single edges are compared.
What repeats is kept as coordinates (document, place, length) with the hash of the words
there, and the last step, which reads the texts, checks every span against its words before
it removes them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import counts_of, prefix_hash, span_hash, text_blocks, words, written
from docsieve.llm.windows import pieces

WINDOW, GRAM = 13, 5
PATH = "mini long, path long, doc long, pos int, n int"


def _word_prefix(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix hash over word hashes, word bounds of the rows)."""
    start, end, row = words(data, offsets)
    _, first = counts_of(row, len(offsets) - 1)
    return prefix_hash(span_hash(prefix_hash(data), start, end)), first


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def _paths(k: int, only_mini: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for begin, end, data, offsets in text_blocks(batch.column(1)):
                prefix, first = _word_prefix(data, offsets)
                p = pieces(prefix, first, k, GRAM)
                mini, docs = p.key.view(np.int64), doc[begin:end][p.row]
                if only_mini:
                    yield pa.RecordBatch.from_arrays([pa.array(mini), pa.array(docs)], names=["mini", "doc"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mini), _signed(p.content), pa.array(docs), pa.array(p.start.astype(np.int32)), pa.array(p.count.astype(np.int32))],
                        names=["mini", "path", "doc", "pos", "n"])
    return run


def _edges(k: int):
    """Single windows of the paths listed per document; paths whose words are others are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, listed = batch.column(0).to_numpy(), batch.column(2)
            for begin, end, data, offsets in text_blocks(batch.column(1)):
                prefix, first = _word_prefix(data, offsets)
                row, pos, n, path = _spans(listed.slice(begin, end - begin))
                start = first[row] + pos
                inside = start + n + k - 1 <= first[row + 1]
                row, pos, n, start, path = row[inside], pos[inside], n[inside], start[inside], path[inside]
                true = span_hash(prefix, start, start + n + k - 1) == path
                row, pos, n, start = row[true], pos[true], n[true], start[true]
                each = np.repeat(np.arange(len(row)), n)
                step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                at = start[each] + step
                yield pa.RecordBatch.from_arrays(
                    [_signed(span_hash(prefix, at, at + k)), pa.array(doc[begin:end][row[each]]), pa.array((pos[each] + step).astype(np.int32))],
                    names=["edge", "doc", "pos"])
    return run


def _spans(listed: pa.Array) -> tuple[np.ndarray, ...]:
    """A column of lists of (pos, n, hash) as flat arrays: (row, pos, n, hash)."""
    row = np.repeat(np.arange(len(listed)), np.asarray(listed.value_lengths().fill_null(0)))
    flat = listed.flatten()
    pos, n, h = (np.asarray(flat.field(i)) for i in range(3))
    return row, pos.astype(np.int64), n.astype(np.int64), h.astype(np.int64).view(np.uint64)


def _remove(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed, out = batch.column(2), []
            for begin, end, data, offsets in text_blocks(batch.column(1)):
                start, stop, row = words(data, offsets)
                _, first = counts_of(row, end - begin)
                drop = np.zeros(len(start) + 1, np.int64)
                at, pos, n, h = _spans(listed.slice(begin, end - begin))
                if len(at):
                    prefix = prefix_hash(span_hash(prefix_hash(data), start, stop))
                    a = first[at] + pos
                    b = a + n + k - 1
                    inside = b <= first[at + 1]
                    a, b, h = a[inside], b[inside], h[inside]
                    true = span_hash(prefix, a, b) == h
                    np.add.at(drop, a[true], 1)
                    np.add.at(drop, b[true], -1)
                kept = np.cumsum(drop[:-1]) == 0
                for i in range(end - begin):
                    own = slice(first[i], first[i + 1])
                    raw, base = data[offsets[i]: offsets[i + 1]].tobytes(), offsets[i]
                    stay = kept[own]
                    if stay.all():
                        text = b" ".join(raw.split())
                    else:
                        text = b" ".join([raw[x - base: y - base] for x, y in zip(start[own][stay].tolist(), stop[own][stay].tolist())])
                    out.append((len(stay), int(len(stay) - stay.sum()), hashlib.sha256(text).hexdigest(), text))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()),
                 pa.array(columns[3], pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
    return run


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document id, the repeated paths and edges: (doc, spans: array of (pos, n, hash)).

    ``n`` windows start at word ``pos``; ``hash`` is that of their words.
    """
    own = docs.select(_order(F.col("doc_id")).alias("doc"), F.col("text").cast("string").alias("text"))
    # minimizers of a single document cannot carry a repeat
    minis = own.mapInArrow(_paths(window, True), "mini long, doc long").groupBy("mini").agg(
        F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("mini")
    minis = written(minis, "shared-minimizers")
    paths = written(own.mapInArrow(_paths(window, False), PATH).join(minis, "mini"), "paths")
    # occurrences of a path after the first document's
    firsts = paths.groupBy("mini", "path").agg(F.min("doc").alias("first"))
    placed = paths.join(firsts, ["mini", "path"])
    later = placed.filter("doc > first").select("doc", "pos", "n", "path")
    # branches: several paths through one minimizer; their first occurrences are compared edge by edge
    branching = firsts.groupBy("mini").agg(F.count("*").alias("m"), F.min("first").alias("low"), F.max("first").alias("high")).filter(
        "m > 1 and low < high").select("mini")
    listed = placed.filter("doc = first").join(branching, "mini", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("pos", "n", "path")).alias("spans"))
    edges = written(own.join(listed, "doc").select("doc", "text", "spans").mapInArrow(_edges(window), "edge long, doc long, pos int"), "edges")
    sources = edges.groupBy("edge").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("edge", "first")
    single = edges.join(sources, "edge").filter("doc > first").select("doc", "pos", F.lit(1).alias("n"), F.col("edge").alias("path"))
    return written(later.unionByName(single).groupBy("doc").agg(F.collect_list(F.struct("pos", "n", "path")).alias("spans")), "spans")


def _order(doc_id: F.Column) -> F.Column:
    """Ids as numbers to compare; null counts as the largest."""
    return F.coalesce(doc_id.cast("long"), F.lit(2**63 - 1))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text.

    A word goes if a window of ``window`` words that covers it also starts in a document with
    a smaller id.  Null and empty texts have no words; a null id is larger than any other;
    rows with one id are one document and remove nothing from each other.  Very long texts are
    cut into paths, whole.  Other columns are ignored; an empty table gives no rows.
    """
    spans = repeated_passages(docs, window)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _order(F.col("doc_id")).alias("doc"))
    return own.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(
        _remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
