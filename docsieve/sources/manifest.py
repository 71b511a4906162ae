"""Inventory of document files with quarantine instead of exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import dims
from docsieve.sources.listing import DocumentFiles

ACCEPTED, QUARANTINED = "ACCEPTED", "QUARANTINED"
NOT_FOUND, NOT_A_FILE, UNSUPPORTED, CORRUPT = "not_found", "not_a_file", "unsupported_type", "corrupt_content"

# ---- Fixed values: leading bytes (hex) of the file formats ----------------------------------
PDF_SIGNATURE = "255044462D"
IMAGE_SIGNATURES = ("89504E470D0A1A0A", "FFD8FF", "474946383", "424D", "49492A00", "4D4D002A", "52494646")


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; '' when there is none (leading dots do not count)."""
    return F.lower(F.regexp_extract(filename(path), r"(?s)[^.].*(\.[^.]+)$", 1))


def file_type(path: Column) -> Column:
    return F.try_element_at(dims.literal_map(dims.FILE_TYPES), extension(path))


def document_id(path: Column) -> Column:
    """Stable across runs, unlike a random id."""
    return F.sha2(path, 256)


def manifest_scan(spark: SparkSession, path: str, signatures: bool = False, **options: int) -> DataFrame:
    """Files below a folder: source_path, file_size_bytes, modified_at (and ``head``).

    All names count, those starting with ``_`` or ``.`` too.  Contents are never read;
    ``signatures`` fetches eight leading bytes of every file that filters on path and size leave.
    ``options`` are those of the ``document_files`` source (folders, files, bytes).
    """
    spark.dataSource.register(DocumentFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    files = spark.read.format("document_files").options(headBytes=8 if signatures else 0, **options).load(path)
    return files if signatures else files.drop("head")


def signature_matches(kind: Column, head: Column) -> Column:
    """Leading bytes fit the declared type (a PDF, or any known image for image types).

    Weaker than decoding the file: a damaged body passes.
    """
    image = F.lit(False)
    for signature in IMAGE_SIGNATURES:
        image = image | head.startswith(signature)
    return F.when(kind == "pdf", head.startswith(PDF_SIGNATURE)).otherwise(image)


def signature_check(files: DataFrame) -> DataFrame:
    """Adds signature_ok to files with source_path and head."""
    return files.withColumn("signature_ok", signature_matches(file_type(F.col("source_path")), F.col("head")))


def manifest_validate(files: DataFrame) -> DataFrame:
    """One row per file: identity, file type, page count, status and reason.

    Optional input columns: ``is_present`` and ``is_file`` (from ``manifest_requests``),
    ``head`` (signature), ``page_count`` (PDFs; images always have one page).
    """
    path, kind = F.col("source_path"), F.col("file_type")
    has = set(files.columns)
    reason = F.when(F.lit(False), "")
    if "is_present" in has:
        reason = reason.when(~F.col("is_present"), NOT_FOUND)
    if "is_file" in has:
        reason = reason.when(~F.col("is_file"), NOT_A_FILE)
    reason = reason.when(kind.isNull(), UNSUPPORTED)
    if "head" in has:
        reason = reason.when(~signature_matches(kind, F.col("head")), CORRUPT)
    pages = F.when(kind != "pdf", 1)
    if "page_count" in has:
        reason = reason.when((kind == "pdf") & (F.col("page_count") < 1), CORRUPT)
        pages = F.when(kind == "pdf", F.col("page_count")).otherwise(pages)
    typed = files.withColumn("file_type", file_type(path)).withColumn("reason", reason)
    return typed.select(
        document_id(path).alias("document_id"),
        filename(path).alias("filename"),
        "file_type", "file_size_bytes",
        pages.cast("int").alias("page_count"),
        "source_path",
        F.when(F.col("reason").isNull(), ACCEPTED).otherwise(QUARANTINED).alias("status"),
        "reason",
    )


def manifest_requests(requested: DataFrame, files: DataFrame) -> DataFrame:
    """Check requested paths (``source_path``) against a scan: adds is_present, is_file.

    A path that is no file but a folder above scanned files is present and not a file.
    """
    parents = files.select(F.split("source_path", "/").alias("_p")).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda n: F.array_join(F.slice("_p", 1, n), "/"))).alias("source_path")
    ).distinct().withColumn("_folder", F.lit(True))
    scanned = files.withColumn("_file", F.lit(True))
    return (
        requested.withColumn("source_path", F.rtrim("source_path", F.lit("/")))
        .join(scanned, "source_path", "left").join(parents, "source_path", "left")
        .withColumn("is_file", F.coalesce("_file", F.lit(False)))
        .withColumn("is_present", F.coalesce("_file", "_folder", F.lit(False)))
        .drop("_file", "_folder")
    )


def accepted(manifest: DataFrame) -> DataFrame:
    return manifest.filter(F.col("status") == ACCEPTED)


def quarantine(manifest: DataFrame) -> DataFrame:
    return manifest.filter(F.col("status") == QUARANTINED)


def page_explode(manifest: DataFrame) -> DataFrame:
    """One row per page of accepted documents, numbered from 1.

    A PDF whose page count is not known gives no page; ``page_select_errors`` lists it.
    """
    return accepted(manifest).filter(F.col("page_count") >= 1).select(
        "document_id", "source_path", "file_type",
        F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_number"),
    )
