"""Word tables stored by document, so that their three groupings need no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsieve.operators.ocr import LINE_KEYS, PAGE_KEYS, ocr_document_text, ocr_lines, ocr_page_text


def write_words(words: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> None:
    """Save words bucketed by document and sorted by page and line, one exchange.

    A bucket is a file; choose their number so that one fits a task.  A document is in one
    bucket, because lines, pages and its text are to meet there.  Words that already lie in as
    many tasks by the hash of their document are not moved.
    """
    writer = words.repartition(buckets, "document_id").write.mode("overwrite").bucketBy(buckets, "document_id").sortBy(*PAGE_KEYS, *LINE_KEYS, "word_idx")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def clustered_text(spark: SparkSession, table: str, min_confidence: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, pages, documents) of words saved by ``write_words``; each level is grouped where it lies."""
    lines = ocr_lines(spark.table(table), min_confidence)
    pages = ocr_page_text(lines)
    return lines, pages, ocr_document_text(pages)
