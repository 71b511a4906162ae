"""Training-corpus pipeline: documents in, packed token sequences out.

Five stages, each over all rows that its predecessor kept: documents of low quality go, of
equal texts one stays, of near duplicates one stays, sources are mixed to their weights, and
what remains is packed into sequences.  Between stages the rows are a table of the shared
folder, so a lost executor repeats at most one stage's tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docsieve.llm import exact_dedup, minhash, mixing, packing, quality
from docsieve.llm.common import written
from docsieve.llm.queries import quality_weights, tokenizer_path
from docsieve.session import ship_package


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.7 or more); odd rows: ``quality.keep_good``."""
    ship_package(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; odd rows: ``exact_dedup.exact_dedup_rows``."""
    ship_package(spark)
    return exact_dedup.exact_dedup_rows(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles the one with the least id.

    Nulls, repeated rows, empty and very long texts: ``minhash.keep_one``.
    """
    ship_package(spark)
    return minhash.keep_one(docs, shingle=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's epochs take them; the last one of a source cut to its budget.

    Nulls, ties, repeated rows, empty and very long texts: ``mixing.mixed_rows``.
    """
    ship_package(spark)
    return mixing.mixed_rows(docs, quality_weights(spark, sf_dir))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset; a repeated document is packed each time.

    Nulls, empty and very long texts: ``packing.pack_documents``.
    """
    ship_package(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: A trained classifier and a tokenizer are no SQL; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
