"""Task family: one parser per task, all in one pass."""

import json
import pytest
from pyspark.sql import functions as F

from docsieve.functions import dims
from docsieve.operators import tasks

SCHEMA = "id string, task string, response string, document_type_hint string"


@pytest.fixture(scope="module")
def parse(spark):
    def run(task, reply, hint=None):
        df = spark.createDataFrame([("r", task, reply, hint)], SCHEMA)
        known = (task,) if task in dims.ANALYSIS_TASKS else (dims.SUMMARY,)
        return tasks.task_dispatch(df, tasks=known).first().asDict(recursive=True)
    return run


@pytest.mark.parametrize(("reply", "expected"), [
    ("Looks like an INVOICE to me", "invoice"), ('{"document_type": "bank_statement"}', "bank_statement"),
    ("a payslip of May", "salary_slip"), ("an identity card", "identity_document"), ("a dog", "unknown"),
    ("one billion reasons", "invoice"),                                   # substring, not word
    ("a passport next to an invoice", "identity_document"),               # earliest wins
    ('a passport {"document_type": "invoice"}', "invoice"),               # declared type is read first
    ('a passport {"document_type": "poem"}', "identity_document"),        # but only if it names a type
    ('{"document_type": "", "type": "payslip", "x": "invoice"}', "salary_slip"),
    ('x invoice {"document_type": 5, "type": "payslip"}', "invoice"),     # a true non-text hides type
    ('x invoice {"document_type": 0, "type": "payslip"}', "salary_slip"),
])
def test_classification(parse, reply, expected):
    got = parse("classification", reply)
    assert got["document_type"] == expected
    assert got["parse_success"] is (expected != "unknown")
    assert got["response"] == reply and got["confidence"] is None


def test_empty_classification(parse):
    got = parse("classification", "  ")
    assert (got["document_type"], got["parse_errors"]) == ("unknown", [dims.EMPTY_REPLY])
    assert parse("classification", None)["parse_errors"] == [dims.EMPTY_REPLY]


def test_kv_json_aliases_and_additional(parse):
    got = parse("key_value_extraction", '{"fields": {"Invoice ID": "A1", "total": 5, "amount": 6, "Vendor": "Acme.", "n": {"x": 1}}}', "invoice")
    assert got["fields"] == {"invoice_number": "A1", "customer": None, "date": None, "item": None, "quantity": None, "amount": "5"}
    assert got["additional_fields"] == {"vendor": "Acme"}
    assert got["document_type"] == "invoice"


def test_kv_first_key_wins_even_when_null(parse):
    got = parse("key_value_extraction", '{"total": "N/A", "amount": "7"}', "invoice")
    assert got["fields"]["amount"] is None and got["parse_success"]


def test_kv_all_null_values_still_succeed(parse):
    assert parse("key_value_extraction", '{"fields": {"amount": "n/a"}}', "invoice")["parse_success"]


def test_kv_lists_and_whole_payload(parse):
    assert parse("key_value_extraction", '{"fields": [{"emp_id": "E1"}, 3, {"net_pay": "9"}]}', "salary_slip")["fields"]["net_salary"] == "9"
    assert parse("key_value_extraction", '```\n[{"a": 1}, {"b": 2}]\n```')["fields"] == {"a": "1", "b": "2"}
    assert parse("key_value_extraction", '[{"a": 1}, {"b": 2}]')["fields"] == {"a": "1"}
    assert parse("key_value_extraction", '{"fields": "none", "dob": "1.1."}', "identity_document")["fields"]["date_of_birth"] == "1.1"


def test_kv_lines_only_without_json_fields(parse):
    reply = "Bill Number: B-1\r\n * Qty = 3\n• Client : Bob\nTotal Amount:\n12: no\nhttp//x"
    got = parse("key_value_extraction", reply, "invoice")
    assert got["fields"] == {"invoice_number": "B-1", "customer": "Bob", "date": None, "item": None, "quantity": "3", "amount": None}
    got = parse("key_value_extraction", 'Qty: 9 {"fields": {"qty": 1}}', "invoice")
    assert got["fields"]["quantity"] == "1"
    got = parse("key_value_extraction", '{"x": {}}\nQty: 9', "invoice")
    assert got["fields"]["quantity"] == "9"


def test_kv_failure_keeps_schema(parse):
    got = parse("key_value_extraction", "I see nothing", "invoice")
    assert set(got["fields"].values()) == {None} and got["parse_errors"] == [dims.NO_KEY_VALUES]
    assert parse("key_value_extraction", "a: b", "Receipt")["parse_errors"] == ["Unsupported document type: Receipt"]


def test_kv_many_keys_and_order(spark, rows):
    keys = ", ".join(f'"k{i % 700}": {i}' for i in range(3000))
    entries = "[" + ", ".join(f'{{"k{i % 700}": {i}}}' for i in range(3000)) + "]"
    df = spark.createDataFrame([("object", "{" + keys + "}"), ("list", "```" + entries + "```")], "id string, response string")
    got = rows(tasks.kv_long(df).filter("field = 'k5'").orderBy("id"))
    assert [(r["id"], r["value"]) for r in got] == [("list", "5"), ("object", "2805")]  # duplicates: JSON last, entries first
    order = rows(tasks.kv_long(df).filter("id = 'list'").orderBy("pos"))
    assert [r["field"] for r in order] == [f"k{i}" for i in range(700)]


def table(parse, reply):
    return parse("table_extraction", reply)["table"]


def test_table_json_forms(parse):
    assert table(parse, '{"columns": ["Date", "<x>"], "rows": [["d", "1."], ["-", null], [], ["e"]]}') == {"columns": ["Date", "<x>"], "rows": [["d", "1"], ["e"]]}
    assert table(parse, '{"rows": [{"a": 1, "b": "x"}, {"b": "y"}, 7]}') == {"columns": ["a", "b"], "rows": [["1", "x"], [None, "y"]]}
    assert table(parse, '```[{"a": 1}, {"b": 2, "a": 3}]```') == {"columns": ["a"], "rows": [["1"], ["3"]]}
    assert table(parse, '{"columns": [1, null], "rows": [{"1": true}]}') == {"columns": ["1", "None"], "rows": [["True", None]]}


def test_table_json_rows_never_fall_back_to_pipes(parse):
    reply = '{"rows": []}\n| a | b |\n| --- | --- |\n| 1 | 2 |'
    got = parse("table_extraction", reply)
    assert got["table"] == {"columns": [], "rows": []} and got["parse_errors"] == [dims.NO_TABLE_ROWS]
    assert table(parse, '{"x": 1}\n| a | b |\n| 1 | 2 |') == {"columns": ["a", "b"], "rows": [["1", "2"]]}


def test_table_pipes(parse):
    assert table(parse, "text\n| a | b |\n| :--- | --: |\n|| 1 |\n| - | n/a |\nx | y\n") == {"columns": ["a", "b"], "rows": [["1"]]}
    assert table(parse, "a | b | c\n-- | -- | --\n1 | | 3") == {"columns": ["a", "b", "c"], "rows": [["1", None, "3"]]}
    assert table(parse, "| a | b |") == {"columns": ["a", "b"], "rows": []}
    assert table(parse, "no table") == {"columns": [], "rows": []}


def test_summary_and_answer(parse):
    assert parse("summarization", "```text\nOne laptop.\n```")["summary"] == "One laptop"
    assert parse("summarization", '{"summary": " Short, "}')["summary"] == "Short"
    assert parse("summarization", '{"summary": 5}')["summary"] == '{"summary": 5}'
    assert parse("summarization", "  ")["parse_errors"] == [dims.NO_SUMMARY]
    assert parse("question_answering", '{"answer": "42"}')["answer"] == "42"
    assert parse("question_answering", "Not visible in document.")["parse_errors"] == [dims.NO_ANSWER]


def test_unknown_task_is_a_row(parse):
    assert parse("forgery", "x")["parse_errors"] == ["Unsupported task: forgery"]


def test_one_python_pass_and_no_shuffle(spark):
    df = spark.createDataFrame([("r", "classification", "x", None)], SCHEMA)
    plan = tasks.task_dispatch(df).filter("parse_success")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    long = tasks.kv_long(df)._jdf.queryExecution().executedPlan().toString()
    assert long.count("ArrowEvalPython") == 1 and "Exchange" not in long


def test_cells_long(spark, rows):
    df = spark.createDataFrame([("t", '{"columns": ["a"], "rows": [["", null], ["1", "2"]]}')], "id string, response string")
    assert rows(tasks.cells_long(df)) == [
        {"id": "t", "row_idx": 0, "col_idx": 0, "column_name": "a", "value": "1"},
        {"id": "t", "row_idx": 0, "col_idx": 1, "column_name": None, "value": "2"}]


def test_nested_cells_are_kept(spark, rows):
    """Nested cells carry their JSON text in every form of a table."""
    items = [{"item": "x", "price": {"amount": 5}}, {"item": None, "price": {"amount": 6}}, {"item": None, "price": None}]
    replies = ["```json\n" + json.dumps(items) + "\n```", json.dumps({"rows": items}), json.dumps({"columns": ["item", "price"], "rows": [list(i.values()) for i in items]}),
               json.dumps({"columns": [{"name": "Date"}, "b"], "rows": [[1, [2, 3]]]}), json.dumps({"columns": "ab", "rows": [{"a": 1, "b": 2}]})]
    parsed = rows(tasks.table_parse(spark.createDataFrame(list(enumerate(replies)), "id int, response string")).orderBy("id"))
    want = [["x", '{"amount":5}'], [None, '{"amount":6}']]
    assert [r["table"]["rows"] for r in parsed[:3]] == [want] * 3
    assert parsed[3]["table"] == {"columns": ['{"name":"Date"}', "b"], "rows": [["1", "[2,3]"]]}
    assert parsed[4]["table"] == {"columns": ["a", "b"], "rows": [["1", "2"]]}


def test_key_lines_meet_the_pattern_once(spark, rows):
    reply = " - Total : 5 \n\tName:  A: b\nno pair\x01here\nx\x01y: 1\n" + " " * 5000 + "\n* Due Date= 2024\n"
    got = rows(tasks.kv_long(spark.createDataFrame([(1, reply)], "id int, response string")))
    assert [r["value"] for r in got] == ["5", "A: b", "2024"]
    plan = tasks.kv_long(spark.createDataFrame([(1, reply)], "id int, response string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Za-z][A-Za-z0-9 _/#.()-]{0,48}") <= 2
