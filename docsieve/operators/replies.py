"""Replies in, JSON tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import dims, jsonreply
from docsieve.functions.text import is_blank


def json_candidates(replies: DataFrame, reply: str = "response") -> DataFrame:
    """One row per candidate JSON text: the input columns but the reply, plus pos and text."""
    found = replies.withColumn("_found", jsonreply.json_candidates(F.col(reply)))
    keep = [c for c in replies.columns if c != reply]
    return jsonreply.explode_rows(found, F.col("_found"), "pos", "candidate").select(*keep, "pos", "candidate")


class JsonCandidates:
    """Table function over one reply: (pos, candidate) of each candidate JSON text."""

    def eval(self, reply: str):
        yield from enumerate(jsonreply.candidate_texts(reply) if reply else ())


def register_functions(spark: SparkSession) -> None:
    """``json_candidates(reply)`` for SQL: ``FROM replies, LATERAL json_candidates(response)``."""
    spark.udtf.register("json_candidates", F.udtf(JsonCandidates, returnType="pos int, candidate string"))


def json_first_valid(replies: DataFrame, reply: str = "response") -> DataFrame:
    """Adds candidate, payload_kind and json_error; exactly one row per reply."""
    first = replies.withColumn("_first", jsonreply.json_first_valid(F.col(reply)))
    error = (
        F.when(is_blank(F.col(reply)), dims.EMPTY_REPLY)
        .when(F.col("_first").isNull(), dims.NO_JSON_OBJECT)
        .otherwise(F.col("_first.error"))
    )
    return first.select(
        *replies.columns,
        F.col("_first.pos").alias("candidate_pos"),
        F.col("_first.candidate").alias("candidate"),
        F.col("_first.kind").alias("payload_kind"),
        error.alias("json_error"),
    )


def json_entries(replies: DataFrame, reply: str = "response") -> DataFrame:
    """Top-level entries of each reply's payload in document order (key NULL for arrays)."""
    shredded = replies.withColumn("_tree", jsonreply.json_tree(F.col(reply), container_text=True))
    keep = [c for c in replies.columns if c != reply]
    rows = jsonreply.explode_rows(shredded, F.col("_tree.nodes"), "pos", "_node")
    return rows.select(
        *keep, F.col("_tree.kind").alias("payload_kind"), "pos", "_node.key", "_node.kind", "_node.value")
