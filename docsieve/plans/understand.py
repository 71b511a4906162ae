"""Files and recognised words in, one understood document per row out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.operators.infer import batch_infer
from docsieve.operators.ocr import ocr_lines, ocr_page_text, page_ocr_join, page_select, page_select_errors
from docsieve.operators.prompts import prompt_object
from docsieve.operators.structured import structured_parse
from docsieve.session import scratch_dir, write_table
from docsieve.sources.manifest import accepted, page_explode

PAGE_COUNT_UNKNOWN = "page_count_unknown"

RESULT = (
    "page_number", "status", "error", "document_type", "fields", "tables", "summary", "confidence", "response",
    "parse_errors", "schema_errors", "parse_success", "schema_valid", "schema_normalized",
)
LOG = (
    "page_number", "status", "error", "model_name", "task", "inference_time", "parse_success", "schema_valid",
    "schema_normalized", "document_type", "field_count", "ocr_text_length", "parse_errors", "schema_errors",
)
#: What the folds read of a page.
FOLDED = tuple(dict.fromkeys(("document_id", "model_name", "ocr_text", "ocr_blocks", "coordinate_space", *RESULT, *LOG)))


def understand_pages(
    manifest: DataFrame, words: DataFrame, task: str, factory, model_key: str = "default",
    page_number: int | None = None, min_confidence: float = 0.0, partitions: int | None = None,
) -> DataFrame:
    """One structured result per page of the accepted documents.

    The page choice is applied to both inputs before anything is grouped or inferred, and
    words of other documents are left out first.  A page whose inference failed has its status
    and error; documents without a page are listed by ``understand_errors``.
    """
    pages = page_select(page_explode(manifest), page_number)
    # the ids of a partition are a small hash table, so no word is sorted to be left out
    known = accepted(manifest).select("document_id").hint("shuffle_hash")
    own = page_select(words, page_number).join(known, "document_id", "left_semi")
    ocr = ocr_page_text(ocr_lines(own, min_confidence))
    prompted = prompt_object(page_ocr_join(pages, ocr).withColumn("task", F.lit(task)))
    prompted = prompted.withColumn("ocr_text_length", F.length(F.coalesce("ocr_text", F.lit(""))))
    replies = batch_infer(prompted, factory, model_key, image="source_path", partitions=partitions)
    return structured_parse(replies)


def understand_errors(manifest: DataFrame, page_number: int | None = None) -> DataFrame:
    """Documents of the manifest that give no page, with the reason: document_id, source_path, error.

    Quarantined files keep their reason; an accepted file with an unknown number of pages
    (a scanned PDF whose pages nobody counted) says so, and one without the requested page too.
    """
    known = accepted(manifest).filter("page_count is not null")
    lacking = page_select_errors(known, page_explode(known), page_number)
    reasons = manifest.filter("status <> 'ACCEPTED' or page_count is null").select(
        "document_id", F.when(F.col("status") == "ACCEPTED", PAGE_COUNT_UNKNOWN).otherwise(F.col("reason")).alias("error"))
    return manifest.select("document_id", "source_path").join(reasons.unionByName(lacking), "document_id")


def fold_documents(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Page results per document: metadata, OCR pages, results and logs, in page order.

    Three folds, joined at the end: an aggregation holds the page texts and blocks of a document,
    or its results, or its logs, never all of them at once.  ``pages`` is read once for each, so it
    should be a table (``understand_documents`` writes one); else inference would run three times.
    """
    key = "document_id"
    ocr, results, logs = fold_ocr(pages), fold_results(pages), fold_logs(pages)
    metadata = manifest.select(key, F.struct("filename", "file_type", "page_count", "source_path").alias("metadata"))
    return results.join(ocr, key).join(logs, key).join(metadata, key).select(
        key, "task", "model_id", "metadata", "ocr", "results", "inference_logs")


def _in_order(*columns: str | Column) -> Column:
    return F.sort_array(F.collect_list(F.struct(*columns)))


def fold_ocr(pages: DataFrame) -> DataFrame:
    """Recognised pages of each document, in page order: document_id, ocr."""
    return pages.groupBy("document_id").agg(
        _in_order("page_number", F.col("ocr_text").alias("text"), F.col("ocr_blocks").alias("blocks"), "coordinate_space").alias("ocr"))


def fold_results(pages: DataFrame) -> DataFrame:
    """Structured results of each document's pages: document_id, task, model_id, results."""
    # Maps are not orderable, so they travel as JSON next to the page number.
    rows = pages.withColumn("fields", F.to_json("fields", {"ignoreNullFields": "false"}))
    return rows.groupBy("document_id").agg(F.first("task").alias("task"), F.max("model_name").alias("model_id"), _in_order(*RESULT).alias("results"))


def fold_logs(pages: DataFrame) -> DataFrame:
    """Log records of each document's pages: document_id, inference_logs."""
    return pages.groupBy("document_id").agg(_in_order(*LOG).alias("inference_logs"))


def understand_documents(manifest: DataFrame, words: DataFrame, task: str, factory, **options) -> DataFrame:
    """Understood documents, one row each.  Pages are written to the shared folder first: each is inferred once.

    The table has what the folds read; the prompts, which hold texts and blocks once more, are not among it.
    """
    spark, folder = words.sparkSession, scratch_dir(words.sparkSession, "understood-pages")
    pages = understand_pages(manifest, words, task, factory, **options).select(*FOLDED)
    write_table(pages, folder)
    return fold_documents(spark.read.schema(pages.schema).parquet(folder), manifest)
