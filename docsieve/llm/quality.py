"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

The n-grams are single words and pairs, each as written (ASCII letters lowered) and as a
shape, in which runs of letters, capitals, digits and repeated signs are one character each:
``Reed,***`` has the shape ``Aa,*``.  Shapes let the model judge words it never met.  A text is
the sparse vector of its log counts, scaled to length one; its score is one dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.llm.common import LOWER, mix, one_text, prefix_hash, span_hash, text_blocks, words

BITS = 18
TRAIN_ROWS = 12_000  # bound of the training sample; labelled rows beyond it are not learned from
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-3, 1e-4
THRESHOLD = 0.7
SCORE, PREDICTED = "__q_score", "__q_predicted"

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 57
_SHAPE[128:] = 97


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a run of texts: (row ends, feature numbers, values)."""
    n = len(offsets) - 1
    start, end, row = words(data, offsets)
    if not len(start):
        return np.zeros(n, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    plain = span_hash(prefix_hash(LOWER[data]), start, end)
    kinds = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[start] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shape = span_hash(prefix_hash(kinds[keep]), place[start], place[end])
    pair = row[1:] == row[:-1]
    keys, rows = [], []
    with np.errstate(over="ignore"):
        for salt, stream in ((1, plain), (2, shape)):
            salt = np.uint64(salt)
            keys += [mix(stream + salt), mix(mix(stream[:-1] * np.uint64(3) + salt) + stream[1:])[pair]]
            rows += [row, row[1:][pair]]
    key = (np.concatenate(rows).astype(np.int64) << BITS) | (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    rows = key >> BITS
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(rows, value * value, minlength=n))
    return np.cumsum(np.bincount(rows, minlength=n)), key & ((1 << BITS) - 1), (value / norm[rows]).astype(np.float32)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights by follow-the-regularised-leader; the last one is the bias."""
    size = (1 << BITS) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    for _ in range(EPOCHS):
        for index, value, label in examples:
            zi = z[index]
            wi = -np.sign(zi) * np.maximum(np.abs(zi) - L1, 0) / ((BETA + np.sqrt(n[index])) / ALPHA + L2)
            g = (1 / (1 + np.exp(-np.clip(wi @ value, -30, 30))) - label) * value
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
            z[index] += g - sigma * wi
            n[index] += g * g
            w[index] = wi
    return (-np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)).astype(np.float32)


def _with_bias(index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.append(index, 1 << BITS), np.append(value, np.float32(1))


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    examples = []
    for batch in batches:
        labels = batch.column(1).to_pylist()
        for first, end, data, offsets in text_blocks(batch.column(0)):
            ends, index, value = features(data, offsets)
            for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
                examples.append((*_with_bias(index[a:b], value[a:b]), labels[first + i]))
    yield pa.RecordBatch.from_arrays([pa.array([train(examples).tobytes()], pa.binary())], names=["weights"])


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 modulo 4; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learned from at most ``rows`` labelled documents, chosen by a hash of their id.

    A document with several labels has the largest; null labels are no labels.  Of the rows
    repeated with one id, one is learned from: that with the least hash of its text.  The sample,
    bounded by ``rows``, is learned from in one task; without any row all weights are 0.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(
        F.max(F.col("quality").cast("int")).alias("label")).filter(~held_out(F.col("l_id")))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    present = known.join(own.select("doc_id"), F.col("l_id") == F.col("doc_id"), "left_semi")
    sample = present.orderBy(F.xxhash64("l_id"), "l_id").limit(rows)
    examples = own.join(F.broadcast(sample), F.col("l_id") == F.col("doc_id")).groupBy("doc_id", "label").agg(one_text("text"))
    model = examples.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").select("text", "label").mapInArrow(
        _train_task, "weights binary").collect()
    return np.frombuffer(model[0]["weights"], np.float32) if model else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with ``__q_score`` (0 to 1) and ``__q_predicted``; the model is 1 MB, its size fixed.

    Every row is scored by its whole text, however long, and repeated rows each; null and empty
    texts get the bias, null ids are no matter.  An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    text = [f.name for f in docs.schema].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            column = batch.column(text)
            for first, end, data, offsets in text_blocks(column):
                ends, index, value = features(data, offsets)
                sums = np.concatenate([[0], np.cumsum(w[index].astype(np.float64) * value)])
                scores[first:end] = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
            scores = 1 / (1 + np.exp(-np.clip(scores + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=[*batch.schema.names, SCORE, PREDICTED])

    schema = T.StructType([*docs.schema.fields, T.StructField(SCORE, T.DoubleType()), T.StructField(PREDICTED, T.IntegerType())])
    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts get the model's bias as score; rows repeated with one id are scored
    each; very long texts are scored whole, one at a time.  Other columns are never read.  An empty table gives no rows; without labels every
    score is 0.5.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(own, fit(docs, labels, rows)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(SCORE).alias("score"), F.col(PREDICTED).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that the classifier accepts, with all their columns (see ``score`` for odd rows).

    Repeated rows stay or go together, null and empty texts by the bias; columns named like the
    scores are replaced.  An empty table gives no rows.
    """
    own = docs.drop(SCORE, PREDICTED)
    return score(own, fit(docs, labels, rows)).filter(F.col(PREDICTED) == 1).select(*own.columns)
