"""Exact deduplication over entries of an extendible-hash index.

Documents become index entries: the equal texts of an Arrow batch are joined into one
entry right where they are read, so a group of copies that holds a third of all rows
enters the index as one entry a batch.  Entries get the bucket number of a directory of
2**depth slots: a bucket with more than ``capacity`` keys is overfull, its entries are written
again with the next hash bit and the directory doubles.

The rows do not come out of the directory: a hash shuffle of the keys brings the entries of a key
together, where they are chained by comparing bytes, so two texts with one hash never merge.  There
are no files by bucket and no owner tasks (see README).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import written

CAPACITY = 50_000
MAX_DEPTH = 40
_EMPTY = pa.py_buffer(b"")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        bodies = [t.as_buffer() or _EMPTY for t in batch.column(1)]
        chains: dict[bytes, list[list]] = {}
        found = []
        for row, doc_id in enumerate(ids):
            digest = hashlib.sha256(memoryview(bodies[row])).digest()
            for entry in chains.setdefault(digest, []):
                if bodies[entry[0]] == bodies[row]:
                    entry[1].append(doc_id)
                    break
            else:
                entry = [row, [doc_id], digest]
                chains[digest].append(entry)
                found.append(entry)
        key = np.array([int.from_bytes(e[2][:8], "big") >> 1 for e in found], np.int64)
        known = [[x for x in e[1] if x is not None] for e in found]
        yield pa.RecordBatch.from_arrays([
            pa.array(key), pa.array([e[2].hex() for e in found], pa.string()),
            pa.array([max(k, default=None) for k in known], pa.int64()),
            pa.array([len(e[1]) for e in found], pa.int64()), pa.array([e[1] for e in found], pa.list_(pa.int64())),
        ], names=["key", "sha", "entry_doc", "n", "doc_ids"])


ENTRY = "key long, sha string, entry_doc long, n long, doc_ids array<long>"


def _slot(depth) -> F.Column:
    """Directory slot of a key: its highest ``depth`` of 63 bits."""
    return F.expr(f"shiftrightunsigned(key, 63 - {depth})") if depth else F.lit(0).cast("long")


def build_index(entries: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, dict[tuple[int, int], None]]:
    """Write the entries as bucket files; returns (entries with depth and slot, directory).

    The directory holds one item per bucket, that is about keys / capacity items.
    """
    level = written(entries.withColumns({"depth": F.lit(0), "slot": F.lit(0).cast("long")}), "index")
    done, directory, depth = [], {}, 0
    while True:
        # distinct keys per bucket: equal keys share a chain and never split
        keys = level.groupBy("slot", "key").count().groupBy("slot").agg(
            F.count("*").alias("keys"), F.min("key").alias("low"), F.max("key").alias("high"))
        sizes = keys.collect()
        over = [r.slot for r in sizes if r["keys"] > capacity and r.low != r.high and depth < MAX_DEPTH]
        directory.update({(depth, r.slot): None for r in sizes if r.slot not in set(over)})
        if not over:
            done.append(level)
            break
        split = F.col("slot").isin(over)
        done.append(level.filter(~split))
        # the directory doubles until the largest bucket would fit; an unsplit bucket keeps its
        # file, to which several slots then point
        most = max(r["keys"] for r in sizes)
        while most > capacity and depth < MAX_DEPTH:
            most, depth = most / 2, depth + 1
        level = written(level.filter(split).withColumns({"depth": F.lit(depth), "slot": _slot(depth)}), "index")
    index = done[0]
    for part in done[1:]:
        index = index.unionByName(part)
    return index, directory


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: compare each text with the heads of its key's chain."""
    key, heads = None, []
    for batch in batches:
        keys, ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        link = []
        for row, k in enumerate(keys):
            if k != key:
                key, heads = k, []
            text = texts[row].as_py() or ""
            for i, head in enumerate(heads):
                if head == text:
                    link.append(i)
                    break
            else:
                heads.append(text)
                link.append(len(heads) - 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ids, pa.int64()), batch.column(3), pa.array(link, pa.int32())],
            names=["key", "entry_doc", "entry_sha", "link"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text equals the empty text.  Of equal texts the largest id stays; rows repeated
    with one id are counted, and each of them is marked kept if its id is the one that
    stays (``exact_dedup_rows`` keeps one).  A null id never stays beside another id;
    a group of null ids alone has keep_id null and is kept.  Other columns are ignored.
    An empty table gives no rows.  Very long texts are hashed and compared whole.
    """
    source = docs.select(F.col(id_col).cast("long").alias("entry_doc"), F.col(text_col).cast("string").alias("text"))
    entries, _ = build_index(source.mapInArrow(_entries, ENTRY), capacity)
    # keys met by several entries need their bytes; all others are unique as they are
    multiple = entries.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    wanted = entries.join(multiple, "key", "left_semi").select("key", "depth", "slot", "entry_doc", F.col("sha").alias("entry_sha")).distinct()
    texts = source.withColumn("entry_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    candidates = wanted.join(
        texts, wanted.entry_doc.eqNullSafe(texts.entry_doc) & (wanted.entry_sha == texts.entry_sha)
    ).select("key", wanted.entry_doc, "text", wanted.entry_sha, "slot")
    owned = candidates.repartition("slot", "key").sortWithinPartitions("key", "entry_doc").drop("slot")
    chained = owned.mapInArrow(_chain, "key long, entry_doc long, entry_sha string, link int").distinct()
    placed = written(entries.join(
        chained.withColumnsRenamed({"key": "c_key", "entry_doc": "c_doc"}),
        (F.col("key") == F.col("c_key")) & F.col("entry_doc").eqNullSafe(F.col("c_doc")) & (F.col("sha") == F.col("entry_sha")), "left",
    ).select("key", F.coalesce("link", F.lit(0)).alias("link"), "sha", "entry_doc", "n", "doc_ids"), "placed")
    groups = placed.groupBy("key", "link").agg(F.max("entry_doc").alias("keep_id"), F.sum("n").alias("group_size"))
    return placed.join(groups, ["key", "link"]).select(
        F.explode("doc_ids").alias("doc_id"), "keep_id", "group_size", "sha",
    ).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; one row of each group.

    Null and empty texts are one group; rows repeated with the id that stays collapse to one, which
    of them is open if their other columns differ.  A group of null ids keeps one row.  Extra
    columns of any name stay; an empty table gives no rows; very long texts are compared whole.
    """
    def key(doc_id: F.Column, sha: F.Column) -> F.Column:
        return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), sha)

    stay = exact_dedup(docs, id_col, text_col).filter("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("__key")).distinct()
    keyed = docs.withColumn("__key", key(F.col(id_col).cast("long"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)))
    return keyed.join(stay, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)
