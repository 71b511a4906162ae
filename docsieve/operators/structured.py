"""Structured-object family: schema validation of JSON replies as data quality.

Per reply, no shuffle: the shredded payload stays an array in the row and the schema
rules are native array expressions over its keys and kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions import dims
from docsieve.functions.jsonreply import explode_rows, json_tree, leaves, node
from docsieve.functions.text import is_blank, let

FIELD_ENTRIES = "array<struct<key:string,kind:string,value:string>>"


def _optional(condition: Column, message) -> Column:
    """One-element array when the condition holds, else an empty array."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(condition, F.array(text)).otherwise(dims.string_array(()))


def _prefixed(prefix: str, names: Column) -> Column:
    return F.transform(names, lambda name: F.concat(F.lit(prefix), name))


def structured_parse(
    replies: DataFrame, reply: str = "response", unwrap: bool = True, ignore_keys: tuple[str, ...] = ()
) -> DataFrame:
    """Validate each reply against the object schema; errors are columns, never exceptions.

    Adds document_type, field_entries, fields, tables (JSON text), summary, confidence,
    parse_errors, schema_errors, parse_success, schema_valid, schema_normalized,
    field_count.  ``field_count`` is 0 when the parse failed.
    """
    top, keys = F.col("_top"), F.col("_keys")
    nodes = F.col("_tree.nodes")
    blank = is_blank(F.col(reply))
    parse_error = (
        F.when(blank, dims.EMPTY_REPLY)
        .when(F.col("_tree").isNull(), dims.NO_JSON_OBJECT)
        .when(F.col("_tree.error").isNotNull(), F.col("_tree.error"))
        .when(F.col("_tree.kind") != "object", dims.NOT_AN_OBJECT)
    )
    only = F.get(nodes, F.lit(0))
    wrapped = F.lit(False)
    if unwrap:
        wrapped = (F.size(nodes) == 1) & (only["key"] == "text") & (only["kind"] == "object")
    outer = F.transform(nodes, lambda n: F.struct(
        n["key"].alias("key"), n["kind"].alias("kind"), n["value"].alias("value"), leaves(n["items"]).alias("items")))
    known = F.filter(
        F.when(F.col("_wrapped"), only["items"]).otherwise(outer),
        lambda n: ~n["key"].isin(*ignore_keys)) if ignore_keys else F.when(F.col("_wrapped"), only["items"]).otherwise(outer)

    staged = (
        replies
        .withColumn("_tree", json_tree(F.col(reply), container_text=True))
        .withColumn("_parse_error", parse_error)
        .withColumn("_ok", F.col("_parse_error").isNull())
        .withColumn("_wrapped", F.col("_ok") & F.coalesce(wrapped, F.lit(False)))
        .withColumn("_top", F.when(F.col("_ok"), known))
        .withColumn("_keys", F.transform(top, lambda n: n["key"]))
        .withColumn("_moved", F.filter(dims.string_array(dims.FLAT_FIELD_NAMES), lambda k: F.array_contains(keys, k)))
        .withColumn("_extra", F.array_except(keys, dims.string_array(dims.REQUIRED_KEYS + dims.OPTIONAL_KEYS)))
        .withColumn("_is", F.struct(*[
            node(top, key).alias(key) for key in dims.REQUIRED_KEYS + dims.OPTIONAL_KEYS]))
    )

    ok, moved, extra = F.col("_ok"), F.col("_moved"), F.col("_extra")
    has = {key: F.array_contains(keys, key) for key in dims.REQUIRED_KEYS}
    kind = {key: F.col(f"_is.{key}.kind") for key in dims.REQUIRED_KEYS + dims.OPTIONAL_KEYS}
    normalized = F.size(moved) > 0
    wrong = {  # NULL (absent) never counts as wrong
        "document_type": ~kind["document_type"].isin("string", "null"),
        "fields": ~normalized & (kind["fields"] != "object"),
        "tables": kind["tables"] != "array",
        "summary": ~kind["summary"].isin("string", "null"),
        "confidence": ~kind["confidence"].isin("number", "boolean", "null"),
    }
    schema_errors = F.concat(
        _optional(F.col("_wrapped"), dims.UNWRAPPED_TEXT),
        _prefixed(dims.UNEXPECTED_FIELD, moved),
        *[_optional(~has[key] & (~normalized if key == "fields" else F.lit(True)), dims.MISSING_FIELD + key)
          for key in dims.REQUIRED_KEYS],
        *[_optional(wrong[key], dims.TYPE_ERRORS[key]) for key in dims.TYPE_ERRORS],
        _prefixed(dims.UNEXPECTED_FIELD, F.sort_array(F.array_except(extra, moved))),
    )
    valid = (F.size(extra) == 0)
    for key in dims.REQUIRED_KEYS:
        valid = valid & has[key]
    for key in dims.TYPE_ERRORS:
        valid = valid & ~F.coalesce(kind["fields"] != "object" if key == "fields" else wrong[key], F.lit(False))

    nested = F.when(kind["fields"] == "object", F.col("_is.fields.items")).otherwise(
        F.lit(None).cast(FIELD_ENTRIES))
    nested = F.coalesce(nested, F.array().cast(FIELD_ENTRIES))
    nested_keys = F.transform(nested, lambda n: n["key"])
    flat = let(leaves(top), lambda known: F.transform(
        F.array_except(moved, nested_keys), lambda k: node(known, k)))
    number = F.col("_is.confidence.value")
    confidence = (
        F.when(kind["confidence"] == "boolean", (number == "True").cast("double"))
        .when(kind["confidence"] == "number", number.try_cast("double"))
    )
    text_of = lambda key: F.when(kind[key] == "string", F.col(f"_is.{key}.value"))
    filled = lambda n: (n["kind"] != "null") & ~((n["kind"] == "string") & (n["value"] == ""))

    results = {
        "document_type": text_of("document_type"),
        "field_entries": F.coalesce(F.when(ok, F.concat(nested, flat)), F.array()).cast(FIELD_ENTRIES),
        "tables": F.when(kind["tables"] == "array", F.col("_is.tables.value")).otherwise(F.lit("[]")),
        "summary": text_of("summary"),
        "confidence": confidence,
        "parse_errors": _optional(~ok, F.col("_parse_error")),
        "schema_errors": F.when(ok, schema_errors).otherwise(dims.string_array(())),
        "parse_success": ok,
        "schema_valid": ok & F.coalesce(valid, F.lit(False)),
        "schema_normalized": ok & F.coalesce(normalized, F.lit(False)),
    }
    kept = [c for c in replies.columns if c not in results]
    return (
        staged.select(*kept, *[column.alias(name) for name, column in results.items()])
        .withColumn("fields", F.map_from_entries(F.transform("field_entries", lambda n: F.struct(n["key"], n["value"]))))
        .withColumn("field_count", F.size(F.filter("field_entries", filled)))
    )


def fields_long(results: DataFrame, *keys: str) -> DataFrame:
    """One row per extracted field: the key columns, pos, field, value, value_kind."""
    rows = explode_rows(results.select(*keys, "field_entries"), F.col("field_entries"), "pos", "_f")
    return rows.select(
        *keys, "pos", F.col("_f.key").alias("field"), F.col("_f.value").alias("value"), F.col("_f.kind").alias("value_kind"))


def schema_errors_long(results: DataFrame, *keys: str) -> DataFrame:
    """One row per schema error, in the order the errors were found."""
    rows = explode_rows(results.select(*keys, "schema_errors"), F.col("schema_errors"), "pos", "error")
    return rows.select(*keys, "pos", "error")


def schema_rates(results: DataFrame, *group_by: str) -> DataFrame:
    """Parse, compliance and normalisation rates with their numerators."""
    ones = lambda name: F.count_if(F.col(name))
    return results.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("replies"),
        ones("parse_success").alias("parsed"),
        ones("schema_valid").alias("compliant"),
        ones("schema_normalized").alias("normalized"),
        F.sum("field_count").alias("fields_extracted"),
    )


def inference_log(
    results: DataFrame,
    model_id: str = "model_name",
    latency: str = "inference_time",
    ocr_text: str | None = "ocr_text",
    ocr_text_length: str | None = None,
    timestamp: Column | None = None,
) -> DataFrame:
    """Log row per (document, page, task) of structured results.

    ``timestamp`` defaults to the query's start time; pass a column to replay.
    """
    length = F.col(ocr_text_length) if ocr_text_length else F.length(F.coalesce(F.col(ocr_text), F.lit("")))
    optional = [c for c in ("document_id", "page_number") if c in results.columns]
    return results.select(
        *optional,
        F.col(model_id).alias("model_id"),
        "task",
        F.col(latency).alias("latency_seconds"),
        "parse_success", "schema_valid", "schema_normalized", "document_type",
        F.col("field_count").alias("number_of_extracted_fields"),
        length.cast("int").alias("ocr_text_length"),
        (F.current_timestamp() if timestamp is None else timestamp).alias("timestamp"),
        "parse_errors", "schema_errors",
    )
