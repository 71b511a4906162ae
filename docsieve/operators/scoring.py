"""Scoring of predictions against ground truth.

Predictions and truth meet once, in one equi-join on the document key with a row per
document on the truth side; the comparison happens inside the row and everything after
is partial aggregation of counts.  A key holding a large share of the predictions is
split by adaptive skew-join handling because the other side has one row for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.functions.jsonreply import explode_rows
from docsieve.functions.partials import sums_and_lowest
from docsieve.functions.text import exact_match, let, ratio4, strip
from docsieve.session import scratch_dir

# ---- Fixed values: names of the strict metrics, in report order ---------------------------
STRICT_METRICS = (
    "field_extraction_accuracy",
    "document_classification_accuracy",
    "ocr_correction_accuracy",
    "json_parse_success",
    "schema_compliance",
    "schema_normalization_rate",
    "field_extraction_count",
)


def _count_true(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda flag: flag))


# ---- normalised metrics -------------------------------------------------------------------

def pair_accuracy(pairs: DataFrame, predicted: str, expected: str, score: str, *group_by: str) -> DataFrame:
    correct = F.count_if(exact_match(F.col(predicted), F.col(expected)))
    counts = pairs.groupBy(*group_by).agg(F.count(F.lit(1)).alias("total"), correct.alias("correct"))
    return counts.withColumn(score, ratio4(F.col("correct"), F.col("total")))


def classification_accuracy(pairs: DataFrame, predicted: str = "predicted", expected: str = "expected", *group_by: str) -> DataFrame:
    return pair_accuracy(pairs, predicted, expected, "accuracy", *group_by)


def qa_exact_match(pairs: DataFrame, predicted: str = "predicted", expected: str = "expected", *group_by: str) -> DataFrame:
    return pair_accuracy(pairs, predicted, expected, "exact_match", *group_by)


def per_field_match(predicted: Column, expected: Column) -> Column:
    """``map<field, boolean>`` over the expected fields; a missing prediction is NULL."""
    return let(predicted, lambda found: F.transform_values(
        expected, lambda name, value: let(F.try_element_at(found, name), lambda got: exact_match(got, value))))


def with_field_accuracy(joined: DataFrame, predicted: str = "fields", expected: str = "expected_fields") -> DataFrame:
    """Adds per_field, total_fields, correct_fields, accuracy to rows holding both sides."""
    return (
        joined
        .withColumn("per_field", per_field_match(F.col(predicted), F.col(expected)))
        .withColumn("total_fields", F.greatest(F.size("per_field"), F.lit(0)))
        .withColumn("correct_fields", F.greatest(_count_true(F.map_values("per_field")), F.lit(0)))
        .withColumn("accuracy", ratio4(F.col("correct_fields"), F.col("total_fields")))
    )


def field_accuracy_doc(predictions: DataFrame, truth: DataFrame, on: str = "document_id") -> DataFrame:
    """Per executed prediction; ``truth`` has ``on`` and ``expected_fields``."""
    joined = predictions.select(on, "fields").join(truth.select(on, "document_type", "expected_fields"), on)
    return with_field_accuracy(joined).select(
        on, "document_type", "total_fields", "correct_fields", "accuracy", "per_field")


def unmatched(predictions: DataFrame, truth: DataFrame, on: str = "document_id") -> DataFrame:
    """Keys that one side alone has, with the reason: ``no_truth`` or ``no_reply``.

    Metrics compare matched rows; these are the rows that they leave out.
    """
    left = predictions.select(on).distinct().withColumn("_reply", F.lit(True))
    right = truth.select(on).distinct().withColumn("_truth", F.lit(True))
    both = left.join(right, on, "full_outer")
    reason = F.when(F.col("_truth").isNull(), "no_truth").when(F.col("_reply").isNull(), "no_reply")
    return both.select(on, reason.alias("reason")).filter("reason is not null")


def field_accuracy_micro(per_document: DataFrame) -> DataFrame:
    """Sums over documents, per document type and in total (document_type NULL)."""
    sums = per_document.rollup("document_type").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("total_fields").alias("total_fields"),
        F.sum("correct_fields").alias("correct_fields"),
    )
    return sums.withColumn("accuracy", ratio4(F.col("correct_fields"), F.col("total_fields")))


def with_table_accuracy(joined: DataFrame, predicted: str = "table", expected: str = "expected_rows") -> DataFrame:
    """Adds position-aligned row and cell counts to rows holding both sides.

    Extra predicted rows and cells cost nothing; an empty expected row is never correct.
    """
    def matches(predicted_rows: Column) -> Column:
        return F.transform("_expected", lambda row, i: let(F.get(predicted_rows, i), lambda found: F.transform(
            row, lambda cell, j: exact_match(F.get(found, j), cell))))

    return (
        joined
        .withColumn("_predicted", F.col(f"{predicted}.rows"))
        .withColumn("_expected", F.col(expected))
        .withColumn("_match", let(F.col("_predicted"), matches))
        .withColumn("expected_rows", F.greatest(F.size("_expected"), F.lit(0)))
        .withColumn("predicted_rows", F.greatest(F.size("_predicted"), F.lit(0)))
        .withColumn("correct_rows", F.size(F.filter(
            F.coalesce("_match", F.array()), lambda m: (F.size(m) > 0) & F.forall(m, lambda x: x))))
        .withColumn("total_cells", F.size(F.flatten(F.coalesce("_match", F.array()))))
        .withColumn("correct_cells", _count_true(F.flatten(F.coalesce("_match", F.array()))))
        .withColumn("row_accuracy", ratio4(F.col("correct_rows"), F.col("expected_rows")))
        .withColumn("cell_accuracy", ratio4(F.col("correct_cells"), F.col("total_cells")))
        .drop("_predicted", "_expected", "_match")
    )


TABLE_COUNTS = ("expected_rows", "predicted_rows", "correct_rows", "total_cells", "correct_cells")


def table_accuracy(predictions: DataFrame, truth: DataFrame, on: str = "document_id") -> DataFrame:
    joined = predictions.select(on, "table").join(truth.select(on, F.col("expected_rows").alias("_truth_rows")), on)
    return with_table_accuracy(joined, expected="_truth_rows").select(
        on, *TABLE_COUNTS, "row_accuracy", "cell_accuracy")


def table_accuracy_micro(per_document: DataFrame, *group_by: str) -> DataFrame:
    sums = per_document.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("documents"), *[F.sum(c).alias(c) for c in TABLE_COUNTS])
    return sums.withColumns({
        "row_accuracy": ratio4(F.col("correct_rows"), F.col("expected_rows")),
        "cell_accuracy": ratio4(F.col("correct_cells"), F.col("total_cells")),
    })


# ---- run metrics ---------------------------------------------------------------------------

def latency_aggregates(seconds: Column) -> dict[str, Column]:
    """Aggregates over the times that are present and not zero."""
    timed = F.when(seconds != 0, seconds)
    return {
        "timed_runs": F.count(timed),
        "total_seconds": F.round(F.sum(timed), 3),
        "mean_seconds": F.round(F.sum(timed) / F.count(timed), 3),
        "min_seconds": F.min(timed),
        "max_seconds": F.max(timed),
    }


def latency_summary(runs: DataFrame, *group_by: str, seconds: str = "inference_time", status: str = "status") -> DataFrame:
    """Count, total, mean, min and max of executed runs' times (0 and NULL left out)."""
    executed = F.when(F.col(status) == "RUN", F.col(seconds))
    return runs.groupBy(*group_by).agg(*[c.alias(name) for name, c in latency_aggregates(executed).items()])


#: Size of a quantile sketch; the rank of an estimate is off by at most SKETCH_ERROR with 99 % confidence.
SKETCH_K = 400
SKETCH_ERROR = 0.0066
QUANTILES = (0.5, 0.9, 0.99)


def latency_sketches(runs: DataFrame, *group_by: str, seconds: str = "inference_time", status: str = "status") -> DataFrame:
    """One mergeable sketch of executed runs' times a group: sketch, timed_runs (0 and NULL left out).

    Kept per run, sketches of any runs can be merged later without their times.
    """
    timed = F.when((F.col(status) == "RUN") & (F.col(seconds) != 0), F.col(seconds).cast("double"))
    return runs.groupBy(*group_by).agg(F.kll_sketch_agg_double(timed, SKETCH_K).alias("sketch"), F.count(timed).alias("timed_runs"))


def latency_quantiles(sketches: DataFrame, *group_by: str, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Merged quantiles p50_seconds, p90_seconds, ... of ``latency_sketches``; NULL where nothing was timed."""
    merged = sketches.groupBy(*group_by).agg(
        F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"), F.sum("timed_runs").alias("timed_runs"))
    estimate = lambda q: F.when(F.col("timed_runs") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))))
    return merged.select(*group_by, "timed_runs", *[estimate(q).alias(f"p{q * 100:g}_seconds") for q in quantiles])


def run_status(runs: DataFrame, *group_by: str, status: str = "status") -> DataFrame:
    """Executed and failed counts; RUN when any run succeeded."""
    executed = F.col(status) == "RUN"
    return runs.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(executed).alias("executed"),
        F.count_if(~executed).alias("failed"),
        F.when(F.coalesce(F.bool_or(executed), F.lit(False)), "RUN").otherwise("FAILED").alias("overall_status"),
    )


# ---- strict metrics ---------------------------------------------------------------------------

def _entry_text(entries: Column, key: Column) -> Column:
    """Predicted text of a field: '' when missing, 'None' for an explicit null."""
    entry = F.get(F.filter(entries, lambda n: n["key"] == key), F.lit(0))
    return F.when(entry.isNull(), "").otherwise(F.coalesce(entry["value"], F.lit("None")))


def strict_metrics(results: DataFrame, samples: DataFrame, on: str = "sample_id") -> DataFrame:
    """Long metric rows (metric, score) of structured results against benchmark samples.

    ``samples`` has ``on``, expected_document_type, expected_fields, corrected_text.
    Metrics without an expectation give no row.
    """
    rows = results.join(samples, on)
    expected = F.col("expected_fields")
    hits = let(F.col("field_entries"), lambda found: F.filter(
        F.map_entries(expected),
        lambda e: strip(_entry_text(found, e["key"])) == strip(F.coalesce(e["value"], F.lit("None")))))
    same = lambda a, b: F.when(b.isNotNull(), F.coalesce((a == b).cast("double"), F.lit(0.0)))
    folded = lambda name: F.lower(strip(F.col(name)))
    scores = (
        F.when(F.size(expected) > 0, F.size(hits) / F.size(expected)),
        same(folded("document_type"), folded("expected_document_type")),
        same(strip(F.col("summary")), strip(F.col("corrected_text"))),
        F.col("parse_success").cast("double"),
        F.col("schema_valid").cast("double"),
        F.col("schema_normalized").cast("double"),
        F.when(F.col("parse_success"), F.col("field_count").cast("double")),
    )
    metrics = F.array(*[F.struct(F.lit(name).alias("metric"), score.alias("score"))
                        for name, score in zip(STRICT_METRICS, scores)])
    keep = [c for c in ("model", "dataset", "task", on, "latency_seconds", "memory_mb") if c in rows.columns]
    long = explode_rows(rows.withColumn("_metrics", metrics), F.col("_metrics"), "_at", "_m")
    return long.select(*keep, "_m.metric", "_m.score").filter(F.col("score").isNotNull())


def bench_summary(metrics: DataFrame, *group_by: str) -> DataFrame:
    """Mean score and row count per model, dataset, task (or given columns) and metric."""
    keys = group_by or ("model", "dataset", "task")
    return metrics.groupBy(*keys, "metric").agg(
        F.count("score").alias("samples"), F.avg("score").alias("mean_score"))


#: Rows of a group that ``bench_cube`` lists.
LISTED = 5


def bench_cube(metrics: DataFrame, *group_by: str, listed: int = LISTED) -> DataFrame:
    """Mean score for every combination of model, dataset, task (or given columns) and metric, some or all summed over.

    ``level`` is the grouping id: one bit a key, the first key's the highest, set where the key is
    summed over (its column is NULL).  ``lowest`` lists the ``listed`` lowest scores of the group
    (score, sample_id).  The rows are read once: a task makes the sums and lists of its finest groups,
    a small table of the shared folder, and the combinations are made of these.
    """
    spark, keys = metrics.sparkSession, (*(group_by or ("model", "dataset", "task")), "metric")
    rows = metrics.select(*keys, F.col("score").cast("double").alias("score"), "sample_id")
    listing = T.ArrayType(T.StructType([rows.schema["score"], rows.schema["sample_id"]]))
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("samples", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("lowest", listing)])
    folder = scratch_dir(spark, "cube-parts")
    rows.mapInArrow(sums_and_lowest(len(keys), listed), schema).write.parquet(folder)
    parts = spark.read.schema(schema).parquet(folder)
    cube = parts.cube(*keys).agg(F.grouping_id().cast("int").alias("level"), F.sum("samples").alias("samples"), F.sum("total").alias("_total"))
    summed = lambda i: F.col("level").bitwiseAND(1 << (len(keys) - 1 - i)) != 0
    low = parts.select(*keys, F.explode("lowest").alias("_low")).select(*keys, "_low.*", F.explode(F.sequence(F.lit(0), F.lit((1 << len(keys)) - 1))).alias("level"))
    low = low.select("level", *[F.when(~summed(i), F.col(k)).alias(k) for i, k in enumerate(keys)], "score", "sample_id")
    place = F.row_number().over(Window.partitionBy("level", *keys).orderBy("score", "sample_id"))
    lists = low.withColumn("_place", place).filter(F.col("_place") <= listed).groupBy("level", *keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_place", "score", "sample_id"))), lambda r: F.struct(r["score"], r["sample_id"])).alias("lowest"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
    joined = cube.alias("c").join(lists.alias("l"), [F.col("c.level") == F.col("l.level"), *same])
    mean = F.when(F.col("c.samples") > 0, F.col("c._total") / F.col("c.samples"))
    return joined.select("c.level", *[f"c.{k}" for k in keys], "c.samples", mean.alias("mean_score"), "l.lowest")
