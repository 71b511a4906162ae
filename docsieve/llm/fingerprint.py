"""Document fingerprints by content-defined chunking.

A gear hash rolls over the bytes of a text; a chunk ends where its bits vanish under a mask.
Chunking is normalised: before the usual size a boundary must pass a stricter mask, after it
a looser one, so sizes gather around the middle.  A boundary depends on the last bytes alone,
so an insertion shifts no other chunk.  The fingerprint is the set of chunk digests with
chunk lengths; likeness is the length-weighted share of one set that another contains.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import prefix_hash, span_hash

LEAST, USUAL, MOST = 8, 20, 80
STRICT, LOOSE = 5, 3  # bits that must vanish before and after the usual size
_GEAR = np.random.default_rng(77).integers(0, 2**16, 256).astype(np.uint16)
ROWS = 1_000
COARSE, MOST_BLOCKS = 64, 20_000


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Gear hash at every byte: the sum of ``gear[byte] << age`` over the last 16 bytes."""
    out = _GEAR[data]
    with np.errstate(over="ignore"):
        for step in (1, 2, 4, 8):
            older = np.zeros_like(out)
            older[step:] = out[:-step] << np.uint16(step)
            out = out + older
    return out


def boundaries(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    gear = gear_hash(data)
    loose = np.flatnonzero(gear >> np.uint16(16 - LOOSE) == 0) + 1
    strict = loose[gear[loose - 1] >> np.uint16(16 - STRICT) == 0]
    # first candidate at or after each position, read once a chunk
    loose, strict = [*loose.tolist(), n], [*strict.tolist(), n]
    ends, start, i, j = [], 0, 0, 0
    while n - start > LEAST:
        low, mid, high = start + LEAST, start + USUAL, min(start + MOST, n)
        while strict[i] < low and strict[i] < n:
            i += 1
        if strict[i] < mid:
            end = strict[i]
        else:
            while loose[j] < mid and loose[j] < n:
                j += 1
            end = min(loose[j], high)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunk_set(data: np.ndarray) -> np.ndarray:
    """Sorted distinct chunks as 40-bit numbers: 32 bits of digest, then 8 of length."""
    ends = np.array(boundaries(data), np.int64)
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.concatenate([[0], ends[:-1]])
    digest = span_hash(prefix_hash(data), starts, ends) >> np.uint64(32)
    return np.unique((digest << np.uint64(8)) | (ends - starts).astype(np.uint64))


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the bytes in a's chunks whose chunks b has too; empty is only like empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    weights = (a & np.uint64(255)).astype(np.float64)
    return float(weights[np.isin(a, b, assume_unique=True)].sum() / weights.sum())


def encode(chunks: np.ndarray) -> str:
    """Ten hexadecimal digits a chunk, in order."""
    return chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first code points of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


OUTPUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and falling id: each row against the next of its block.

    The last row of a block is a copy of the next block's first row and gives no result.
    """
    last = None  # (block, doc_id, text, chunks) that waits for its successor
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], names=names)
        rows.clear()
        return out

    for part in batches:
        blocks, ids = part.column(0).to_pylist(), part.column(1).to_pylist()
        for i, (block, doc_id) in enumerate(zip(blocks, ids)):
            text = part.column(2)[i].as_py() or ""
            chunks = chunk_set(_bytes(text))
            if last is not None and last[0] == block:
                _, own_id, own, own_chunks = last
                edited = edited_text(own, text)
                edited_chunks = chunk_set(_bytes(edited))
                rows.append((own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encode(own_chunks),
                             encode(edited_chunks), containment(own_chunks, edited_chunks), containment(own_chunks, chunks)))
            last = (block, doc_id, text, chunks)
            if len(rows) >= 500:
                yield batch()
    if rows:
        yield batch()


def _rank(value: F.Column, cuts: list[int]) -> F.Column:
    """How many of the sorted ``cuts`` are at most ``value``: a binary search as nested conditions."""
    def search(low: int, high: int) -> F.Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < cuts[mid], search(low, mid)).otherwise(search(mid + 1, high))

    return search(0, len(cuts))


def _block(ids: DataFrame, rows_per_block: int) -> F.Column:
    """Block number of a doc_id, growing as ids fall; null belongs to the last block.

    Quantiles of the ids give up to 64 coarse ranges, each of which is divided evenly.
    """
    known = ids.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
                    F.percentile_approx("doc_id", [k / COARSE for k in range(1, COARSE)], 10_000).alias("cuts")).first()
    parts = min(MOST_BLOCKS, -(-known["n"] // rows_per_block))
    if parts <= 1:
        return F.lit(0).cast("long")
    cuts = sorted({int(c) for c in known["cuts"] if known["low"] < int(c) <= known["high"]})
    fine = -(-parts // (len(cuts) + 1))
    edges = [known["low"], *cuts, known["high"] + 1]
    rank = _rank(F.col("doc_id"), cuts)
    # whole numbers all the way: ids may be neighbours beyond 2^53, or at both ends of the long range
    low, high = (F.element_at(F.array(*[F.lit(str(e)).cast("decimal(20,0)") for e in part]), rank + 1) for part in (edges[:-1], edges[1:]))
    step = F.call_function("div", (high - F.col("doc_id").cast("decimal(20,0)") - 1) * fine, high - low)
    last = (len(cuts) + 1) * fine
    return F.when(F.col("doc_id").isNull(), last).otherwise((len(cuts) - rank) * fine + step).cast("long")


def fingerprints(docs: DataFrame, rows_per_block: int = ROWS) -> DataFrame:
    """Fingerprints of documents and of their edited texts; see ``OUTPUT`` for the columns.

    The next document is the one with the next smaller doc_id, after the last the first; a
    sole document is its own next.  Null ids come last.  Rows repeated with one id follow
    each other in order of text.  A null or empty text has n_chars 0 and an empty
    fingerprint; a very long one is chunked whole, as a row of its own.  Other columns are
    ignored; an empty table gives no rows.

    Ids are cut into blocks of about ``rows_per_block`` rows (at most ``MOST_BLOCKS``, which
    then are longer: a block is streamed); every block gets, besides its own rows, a copy of
    the row that follows it, so texts are shuffled once and no task needs another's rows.
    The driver sees one id a block.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # order: falling id, nulls last, then text; equal ids share a block
    block = _block(texts.select("doc_id").filter("doc_id is not null"), rows_per_block)
    blocked = texts.withColumn("block", block)
    firsts = blocked.groupBy("block").agg(F.max("doc_id").alias("first_id")).collect()
    order = sorted(firsts, key=lambda r: r["block"])
    if not order:
        return texts.limit(0).mapInArrow(_compare, OUTPUT)
    # the first row of a block: its largest id (null only if all are), smallest text
    before = {r["block"]: order[i - 1]["block"] for i, r in enumerate(order)}
    lead = spark.createDataFrame([(r["first_id"], before[r["block"]]) for r in order], "first_id long, to_block long")
    heads = texts.join(F.broadcast(lead), texts.doc_id.eqNullSafe(lead.first_id)).groupBy("to_block", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = blocked.select("block", F.lit(0).alias("tail"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).unionByName(
        heads.select(F.col("to_block").alias("block"), F.lit(1).alias("tail"), "doc_id", "text"))
    # four small blocks a task on average, so that a task with more of them is not much longer
    return rows.repartition(-(-len(order) // 4), "block").sortWithinPartitions("block", "tail", F.col("doc_id").desc_nulls_last(), "text").select(
        "block", "doc_id", "text").mapInArrow(_compare, OUTPUT)
