"""Recognised words to lines, pages and documents.

Three groupings of growing scope.  Each collapses map-side before it shuffles, so words
leave a task as line arrays and lines as page text; no level regroups raw words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions import dims
from docsieve.functions.text import round4, strip
from docsieve.operators.coordinates import one_space

# Line order inside a page: the page number of the word record comes last.
LINE_KEYS = ("block_num", "par_num", "line_num", "page_num")
PAGE_KEYS = ("document_id", "page_number")
BLOCK = "struct<text:string,bbox:array<int>,confidence:double>"


def ocr_word_filter(words: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Drop blank words, non-words (conf < 0) and words below the threshold; conf to 0..1."""
    confidence = F.col("conf").cast("double") / 100.0
    return (
        words.withColumn("text", strip(F.col("text").cast("string")))
        .filter((F.col("text") != "") & (F.col("conf") >= 0) & (confidence >= min_confidence))
        .withColumn("confidence", confidence)
        .drop("conf")
    )


def ocr_lines(words: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """One row per text line: text in word order, enclosing box, mean confidence, coordinate space.

    Words may name their ``coordinate_space``; a line of several spaces has no box.
    """
    in_order = F.sort_array(F.collect_list(F.struct("word_idx", "text")))
    edge = lambda start, size: (F.col(start) + F.col(size)).cast("int")
    lines = ocr_word_filter(words, min_confidence).groupBy(*PAGE_KEYS, *LINE_KEYS).agg(
        in_order.alias("_words"),
        F.min(F.col("left").cast("int")).alias("_left"),
        F.min(F.col("top").cast("int")).alias("_top"),
        F.max(edge("left", "width")).alias("_right"),
        F.max(edge("top", "height")).alias("_bottom"),
        # decimal sum: the same result in whatever order partial sums are merged
        F.sum(F.col("confidence").cast("decimal(18,8)")).alias("_confidence"),
        F.count(F.lit(1)).alias("word_count"),
        *[c.alias(name) for name, c in one_space(words).items()],
    )
    return lines.select(
        *PAGE_KEYS, *LINE_KEYS,
        F.array_join(F.transform("_words", lambda w: w["text"]), " ").alias("text"),
        F.when(F.col("space_error").isNull(), F.array("_left", "_top", "_right", "_bottom")).alias("bbox"),
        round4(F.col("_confidence").cast("double") / F.col("word_count")).alias("confidence"),
        "word_count", "coordinate_space", "space_error",
    )


def ocr_page_text(lines: DataFrame) -> DataFrame:
    """One row per page: line texts joined by newline, the ordered blocks and their coordinate space."""
    block = F.struct("text", "bbox", "confidence")
    ordered = F.sort_array(F.collect_list(F.struct(*LINE_KEYS, block.alias("block"))))
    pages = lines.groupBy(*PAGE_KEYS).agg(ordered.alias("_lines"), *[c.alias(name) for name, c in one_space(lines).items()])
    blocks = F.transform("_lines", lambda line: line["block"])
    return pages.select(
        *PAGE_KEYS,
        F.array_join(F.transform("_lines", lambda line: line["block"]["text"]), "\n").alias("text"),
        blocks.alias("blocks"), "coordinate_space", "space_error",
    )


def ocr_document_text(pages: DataFrame) -> DataFrame:
    """One row per document: non-empty page texts in page order; NULL when there is none."""
    texts = F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("page_number", "text"))))
    documents = pages.groupBy("document_id").agg(texts.alias("_pages"))
    joined = F.array_join(F.transform("_pages", lambda p: p["text"]), "\n")
    return documents.select("document_id", F.nullif(joined, F.lit("")).alias("ocr_text"))


def ocr_documents(pages: DataFrame) -> DataFrame:
    """Nested document: ``pages array<struct<page_number, text, blocks, coordinate_space>>`` in page order."""
    parts = [c for c in ("page_number", "text", "blocks", "coordinate_space") if c in pages.columns]
    return pages.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("pages"))


def page_ocr_join(pages: DataFrame, ocr_pages: DataFrame) -> DataFrame:
    """Attach OCR text and blocks to every page; pages without OCR stay (NULL, no blocks)."""
    carried = [c for c in ("coordinate_space", "space_error") if c in ocr_pages.columns and c not in pages.columns]
    ocr = ocr_pages.select(*PAGE_KEYS, F.col("text").alias("ocr_text"), F.col("blocks").alias("ocr_blocks"), *carried)
    joined = pages.join(ocr, list(PAGE_KEYS), "left")
    return joined.withColumn("ocr_blocks", F.coalesce("ocr_blocks", F.array().cast(f"array<{BLOCK}>")))


def page_select(pages: DataFrame, page_number: int | Column | None = None) -> DataFrame:
    """All pages, or the one requested; filter before joins so it reaches the scan."""
    if page_number is None:
        return pages
    wanted = F.lit(page_number) if isinstance(page_number, int) else page_number
    return pages.filter(F.col("page_number") == wanted)


def page_select_errors(documents: DataFrame, pages: DataFrame, page_number: int | None = None) -> DataFrame:
    """Documents whose selection is empty, with the reason."""
    missing = documents.select("document_id").distinct().join(
        page_select(pages, page_number).select("document_id"), "document_id", "left_anti")
    if page_number is None:
        return missing.withColumn("error", F.lit(dims.NO_PAGES))
    some = pages.select("document_id").distinct().withColumn("_has_pages", F.lit(True))
    reason = F.when(F.col("_has_pages"), dims.PAGE_NOT_FOUND.format(page_number)).otherwise(dims.NO_PAGES)
    return missing.join(some, "document_id", "left").select("document_id", reason.alias("error"))
