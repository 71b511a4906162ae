from pyspark.sql import functions as F

from docsieve.operators import scoring
from docsieve.plans import report


def test_pairs(spark, rows):
    pairs = spark.createDataFrame([("Invoice.", "invoice"), (None, "x"), (None, None)], "predicted string, expected string")
    assert rows(scoring.classification_accuracy(pairs)) == [{"total": 3, "correct": 2, "accuracy": 0.6667}]
    assert rows(scoring.qa_exact_match(pairs.limit(0))) == [{"total": 0, "correct": 0, "exact_match": None}]


def test_field_accuracy(spark, rows):
    predicted = spark.createDataFrame([("d1", {"a": "1", "extra": "x"}), ("d2", {}), ("d3", {"a": "1"})], "document_id string, fields map<string,string>")
    truth = spark.createDataFrame([("d1", "t", {"a": "1", "b": None, "c": "3"}), ("d2", "u", {}), ("d4", "t", {"a": "1"})], "document_id string, document_type string, expected_fields map<string,string>")
    per_document = scoring.field_accuracy_doc(predicted, truth)
    got = {r["document_id"]: r for r in rows(per_document)}
    assert set(got) == {"d1", "d2"}
    assert {r["document_id"]: r["reason"] for r in rows(scoring.unmatched(predicted, truth))} == {"d3": "no_truth", "d4": "no_reply"}
    assert got["d1"]["per_field"] == {"a": True, "b": True, "c": False} and got["d1"]["accuracy"] == 0.6667
    assert (got["d2"]["total_fields"], got["d2"]["accuracy"]) == (0, None)
    micro = {r["document_type"]: (r["documents"], r["total_fields"], r["correct_fields"], r["accuracy"]) for r in rows(scoring.field_accuracy_micro(per_document))}
    assert micro == {"t": (1, 3, 2, 0.6667), "u": (1, 0, 0, None), None: (2, 3, 2, 0.6667)}


def test_table_accuracy(spark, rows):
    table = "struct<columns:array<string>,rows:array<array<string>>>"
    predicted = spark.createDataFrame([
        ("d1", (["a"], [["1", "2", "more"], ["3", "9"], ["extra"]])), ("d2", ([], [])), ("d3", ([], [["x"]])), ("d4", None)], f"document_id string, table {table}")
    truth = spark.createDataFrame([("d1", [["1", "2"], ["3", "4"]]), ("d2", [["1"], [None], []]), ("d3", []), ("d4", [["1"]])], "document_id string, expected_rows array<array<string>>")
    got = {r["document_id"]: tuple(r[c] for c in (*scoring.TABLE_COUNTS, "row_accuracy", "cell_accuracy")) for r in rows(scoring.table_accuracy(predicted, truth))}
    assert got["d1"] == (2, 3, 1, 4, 3, 0.5, 0.75)
    assert got["d2"] == (3, 0, 1, 2, 1, 0.3333, 0.5)       # expected NULL meets nothing; the empty row is never right
    assert got["d3"] == (0, 1, 0, 0, 0, None, None)
    assert got["d4"] == (1, 0, 0, 1, 0, 0.0, 0.0)


def test_latency_and_status(spark, rows):
    runs = spark.createDataFrame([("RUN", 1.5), ("RUN", 0.0), ("RUN", None), ("FAILED", 9.0), ("RUN", 2.0005)], "status string, inference_time double")
    got = rows(scoring.latency_summary(runs))[0]
    assert (got["timed_runs"], got["min_seconds"], got["max_seconds"], got["mean_seconds"]) == (2, 1.5, 2.0005, 1.75)
    assert rows(scoring.run_status(runs)) == [{"runs": 5, "executed": 4, "failed": 1, "overall_status": "RUN"}]
    assert rows(scoring.run_status(runs.filter("status = 'FAILED'")))[0]["overall_status"] == "FAILED"
    assert rows(scoring.run_status(runs.limit(0)))[0]["overall_status"] == "FAILED"


def test_report_over_failed_and_run(spark, rows):
    truth = spark.createDataFrame([
        ("d1", "/1.png", "invoice", "q?", "5", {"amount": "5"}, [["5"]]), ("d2", "/unreadable.png", "invoice", "q?", None, {"amount": "6"}, [])],
        "document_id string, image_path string, document_type string, question string, answer string, expected_fields map<string,string>, expected_rows array<array<string>>")
    from docsieve.operators.infer import echo_predictor_factory

    def answer(image_ref, prompt):
        return '{"document_type": "invoice", "fields": {"total": 5}, "rows": [["5"]], "columns": ["Amount"], "answer": "5", "summary": "s"}'

    replies = report.infer_truth_documents(truth, echo_predictor_factory(reply=answer), "answer")
    runs = report.score_runs(replies, truth)
    assert runs.filter("status = 'FAILED' AND (label_correct IS NOT NULL OR parse_success IS NOT NULL)").count() == 0
    got = rows(report.eval_report(runs, "m", {"k": "v"}))[0]
    metrics = got["metrics"]
    assert (got["status"], got["documents_evaluated"], len(got["tasks_evaluated"])) == ("RUN", 2, 5)
    assert metrics["classification"] == {"total": 1, "correct": 1, "accuracy": 1.0}
    assert metrics["key_value_extraction"] == {"total_fields": 1, "correct_fields": 1, "accuracy": 1.0}
    assert metrics["table_extraction"]["cell_accuracy"] == 1.0 and metrics["question_answering"]["exact_match"] == 1.0
    assert metrics["summarization"]["score"] is None and got["inference_time_seconds"]["runs"] == 5


def test_predictions_of_one_hot_document(spark):
    """A third of all predictions for one document: counts stay whole."""
    keys = spark.range(30000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("document_id"))
    predictions = keys.select("document_id", F.create_map(F.lit("a"), F.lit("1")).alias("fields"))
    truth = keys.distinct().select("document_id", F.lit("t").alias("document_type"), F.create_map(F.lit("a"), F.lit("1")).alias("expected_fields"))
    total = scoring.field_accuracy_micro(scoring.field_accuracy_doc(predictions, truth)).filter("document_type IS NULL").first()
    assert (total.documents, total.correct_fields) == (30000, 30000)


def test_replies_meet_the_truth_before_they_are_parsed(spark):
    """Parsed replies lie by no key, so a join after the parsing dealt every one of them anew."""
    n = 3
    keys = spark.range(40).select(F.col("id").cast("string").alias("document_id"))
    replies = keys.select("document_id", F.lit("classification").alias("task"), F.lit(None).cast("string").alias("document_type_hint"), F.lit("RUN").alias("status"), F.lit("A passport").alias("response"))
    truth = keys.select("document_id", F.lit("identity_document").alias("document_type"), F.create_map(F.lit("a"), F.lit("1")).alias("expected_fields"), F.array(F.array(F.lit("1"))).alias("expected_rows"), F.lit("x").alias("answer"))
    runs = report.score_runs(replies.repartition(n, "document_id"), truth.repartition(n, "document_id"))
    plan = runs._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Join")  # the parser stands above the join
    assert (runs.count(), runs.filter("label_correct").count()) == (40, 40)
