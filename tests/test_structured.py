import json

import pytest
from pyspark.sql import functions as F

from docsieve.functions import dims
from docsieve.operators import scoring, structured


@pytest.fixture(scope="module")
def parse(spark):
    def run(reply, **options):
        text = reply if isinstance(reply, str) or reply is None else json.dumps(reply)
        df = spark.createDataFrame([("d", text)], "document_id string, response string")
        return structured.structured_parse(df, **options).first().asDict(recursive=True)
    return run


GOOD = {"document_type": "invoice", "fields": {"a": "1", "b": "", "c": None}, "tables": [{"q": 1}], "summary": None}


def flags(got):
    return got["parse_success"], got["schema_valid"], got["schema_normalized"]


def test_valid(parse):
    got = parse(GOOD)
    assert flags(got) == (True, True, False) and got["schema_errors"] == []
    assert got["field_count"] == 1 and got["tables"] == '[{"q":1}]'
    assert parse({**GOOD, "confidence": 0.5})["confidence"] == 0.5


def test_failures_keep_raw(parse):
    for reply, error in [("", dims.EMPTY_REPLY), (None, dims.EMPTY_REPLY), (" \n", dims.EMPTY_REPLY), ("prose", dims.NO_JSON_OBJECT), ("{never closed", dims.NO_JSON_OBJECT), ("```\n[1]\n```", dims.NOT_AN_OBJECT)]:
        got = parse(reply)
        assert flags(got) == (False, False, False) and got["parse_errors"] == [error]
        assert got["response"] == reply and got["schema_errors"] == [] and got["field_count"] == 0
    assert parse("{bad}")["parse_errors"][0].startswith(dims.MALFORMED_JSON)


def test_unwrapped_text_is_valid_with_error(parse):
    got = parse({"text": GOOD})
    assert flags(got) == (True, True, False)
    assert got["schema_errors"] == [dims.UNWRAPPED_TEXT] and got["fields"] == {"a": "1", "b": "", "c": None}
    assert parse({"text": GOOD, "x": 1})["schema_valid"] is False


def test_flat_fields_move_and_existing_wins(parse):
    got = parse({"document_type": "invoice", "date": "drop", "company": "C", "fields": {"date": "keep"}, "tables": [], "summary": "s"})
    assert flags(got) == (True, False, True) and got["fields"] == {"date": "keep", "company": "C"}
    assert [e["key"] for e in got["field_entries"]] == ["date", "company"]


def test_flat_move_replaces_wrong_fields(parse):
    got = parse({"fields": [1], "invoice_number": "1", "document_type": "x", "tables": [], "summary": ""})
    assert got["schema_errors"] == [dims.UNEXPECTED_FIELD + "invoice_number"] and got["fields"] == {"invoice_number": "1"}


def test_error_order(parse):
    got = parse({"total_amount": 1, "invoice_number": 2, "document_type": 3, "confidence": "high", "zz": 1, "Aa": 2, "aa": 3})
    assert got["schema_errors"] == [
        dims.UNEXPECTED_FIELD + "invoice_number", dims.UNEXPECTED_FIELD + "total_amount",
        dims.MISSING_FIELD + "tables", dims.MISSING_FIELD + "summary",
        dims.TYPE_ERRORS["document_type"], dims.TYPE_ERRORS["confidence"],
        dims.UNEXPECTED_FIELD + "Aa", dims.UNEXPECTED_FIELD + "aa", dims.UNEXPECTED_FIELD + "zz"]


def test_all_types_wrong(parse):
    got = parse({"document_type": 1, "fields": "x", "tables": {}, "summary": []})
    assert got["schema_errors"] == [dims.TYPE_ERRORS[k] for k in ("document_type", "fields", "tables", "summary")]
    assert (got["document_type"], got["fields"], got["tables"], got["summary"]) == (None, {}, "[]", None)


def test_boolean_confidence_is_a_number(parse):
    got = parse({**GOOD, "confidence": True})
    assert got["confidence"] == 1.0 and got["schema_valid"]
    assert parse({**GOOD, "confidence": None})["schema_valid"]
    assert parse({**GOOD, "confidence": "x"})["schema_valid"] is False


def test_given_objects_skip_unwrap_and_metadata(parse):
    got = parse({**GOOD, "raw_response": "r", "parse_success": True}, unwrap=False, ignore_keys=dims.PREDICTION_META_KEYS)
    assert got["schema_valid"] and got["schema_errors"] == []
    assert parse({"text": GOOD}, unwrap=False)["schema_valid"] is False


def test_long_tables_log_and_rates(spark, rows):
    df = spark.createDataFrame(
        [("d1", 1, json.dumps(GOOD), "m", "ocr_correction", 1.5, "abc"), ("d2", 2, "oops", "m", "ocr_correction", None, None)],
        "document_id string, page_number int, response string, model_name string, task string, inference_time double, ocr_text string")
    parsed = structured.structured_parse(df)
    assert rows(structured.fields_long(parsed, "document_id").filter("field = 'a'")) == [
        {"document_id": "d1", "pos": 0, "field": "a", "value": "1", "value_kind": "string"}]
    log = rows(structured.inference_log(parsed, timestamp=F.lit("2024-01-01").cast("timestamp")).orderBy("document_id"))
    assert [(r["ocr_text_length"], r["latency_seconds"], r["number_of_extracted_fields"], r["parse_success"]) for r in log] == [(3, 1.5, 1, True), (0, None, 0, False)]
    rates = rows(structured.schema_rates(parsed))[0]
    assert (rates["replies"], rates["parsed"], rates["compliant"]) == (2, 1, 1)


def strict(spark, reply, expected, doc_type="invoice", corrected=None):
    parsed = structured.structured_parse(spark.createDataFrame([("s", reply)], "sample_id string, response string"))
    samples = spark.createDataFrame([("s", doc_type, expected, corrected)], "sample_id string, expected_document_type string, expected_fields map<string,string>, corrected_text string")
    return {r.metric: r.score for r in scoring.strict_metrics(parsed, samples).collect()}


def test_strict_metrics(spark):
    got = strict(spark, json.dumps({"document_type": " INVOICE ", "invoice_number": "1", "customer_name": "B"}), {"invoice_number": "1 ", "customer_name": "b"})
    assert got == {"field_extraction_accuracy": 0.5, "document_classification_accuracy": 1.0, "json_parse_success": 1.0,
                   "schema_compliance": 0.0, "schema_normalization_rate": 1.0, "field_extraction_count": 2.0}


def test_strict_metrics_missing_and_null(spark):
    got = strict(spark, json.dumps({**GOOD, "summary": "text "}), {"c": None, "x": "", "y": "v"}, None, "text")
    assert got["field_extraction_accuracy"] == 2 / 3 and got["ocr_correction_accuracy"] == 1.0
    assert "document_classification_accuracy" not in got
    failed = strict(spark, "nothing", {}, "invoice", "t")
    assert failed == {"document_classification_accuracy": 0.0, "ocr_correction_accuracy": 0.0, "json_parse_success": 0.0, "schema_compliance": 0.0, "schema_normalization_rate": 0.0}
