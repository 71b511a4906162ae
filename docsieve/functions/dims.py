"""Dimension values of the document model.

Everything under "Fixed values" is part of the data contract: results only match when
these words, names and messages are exactly these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- Fixed values: tasks -------------------------------------------------------------
OBJECT_TASKS = (
    "document_understanding",
    "key_value_extraction",
    "document_classification",
    "table_understanding",
    "ocr_correction",
)
CLASSIFICATION = "classification"
KEY_VALUE = "key_value_extraction"
TABLE = "table_extraction"
SUMMARY = "summarization"
QA = "question_answering"
ANALYSIS_TASKS = (CLASSIFICATION, KEY_VALUE, TABLE, SUMMARY, QA)

# ---- Fixed values: document types and their fields, in schema order -------------------
DOCUMENT_SCHEMAS = {
    "invoice": ("invoice_number", "customer", "date", "item", "quantity", "amount"),
    "bank_statement": (
        "account_name", "statement_period", "transaction_date", "description",
        "debit", "credit", "balance",
    ),
    "salary_slip": (
        "employee_name", "employee_id", "pay_period", "basic_salary",
        "allowances", "deductions", "net_salary",
    ),
    "identity_document": (
        "document_type", "name", "document_number", "date_of_birth", "expiry_date",
    ),
    "unknown": (),
}
UNKNOWN_TYPE = "unknown"

# ---- Fixed values: phrases that are evidence for a document type ----------------------
TYPE_PHRASES = {
    "invoice": ("invoice", "bill", "tax invoice"),
    "bank_statement": (
        "bank_statement", "bank statement", "account statement", "statement of account",
    ),
    "salary_slip": (
        "salary_slip", "salary slip", "payslip", "pay slip", "pay stub", "payroll slip",
    ),
    "identity_document": (
        "identity_document", "identity document", "identity card", "id card",
        "identification card", "passport", "driving licence", "driver's license",
    ),
}

# ---- Fixed values: synonyms of field names ---------------------------------------------
FIELD_ALIASES = {
    "invoice_no": "invoice_number",
    "invoice_id": "invoice_number",
    "bill_number": "invoice_number",
    "customer_name": "customer",
    "client": "customer",
    "billed_to": "customer",
    "invoice_date": "date",
    "issue_date": "date",
    "item_name": "item",
    "description_of_item": "item",
    "qty": "quantity",
    "total": "amount",
    "total_amount": "amount",
    "amount_due": "amount",
    "account_holder": "account_name",
    "account_holder_name": "account_name",
    "period": "statement_period",
    "statement_dates": "statement_period",
    "date_of_transaction": "transaction_date",
    "withdrawal": "debit",
    "deposit": "credit",
    "closing_balance": "balance",
    "employee": "employee_name",
    "emp_name": "employee_name",
    "emp_id": "employee_id",
    "employee_code": "employee_id",
    "pay_month": "pay_period",
    "salary_period": "pay_period",
    "basic": "basic_salary",
    "basic_pay": "basic_salary",
    "allowance": "allowances",
    "deduction": "deductions",
    "net_pay": "net_salary",
    "take_home": "net_salary",
    "full_name": "name",
    "holder_name": "name",
    "id_number": "document_number",
    "document_no": "document_number",
    "dob": "date_of_birth",
    "birth_date": "date_of_birth",
    "date_of_expiry": "expiry_date",
    "valid_until": "expiry_date",
}

# ---- Fixed values: texts that stand for "no value" -------------------------------------
NULL_TOKENS = (
    "", "-", "--", "n/a", "na", "none", "null", "unknown", "not visible",
    "not visible in document", "not available", "not provided",
)
PLACEHOLDER_PATTERN = r"^<[^<>]*>$"

# ---- Fixed values: the structured-object schema ------------------------------------------
REQUIRED_KEYS = ("document_type", "fields", "tables", "summary")
OPTIONAL_KEYS = ("confidence",)
FLAT_FIELD_NAMES = ("invoice_number", "date", "customer_name", "company", "total_amount")
PREDICTION_META_KEYS = (
    "raw_response", "page_number", "parse_errors", "schema_errors",
    "parse_success", "schema_valid", "schema_normalized",
)

# ---- Fixed values: error messages ---------------------------------------------------------
EMPTY_REPLY = "Model output is empty"
NO_JSON_OBJECT = "No JSON object found in model output"
MALFORMED_JSON = "Malformed JSON in model output: "
NOT_AN_OBJECT = "Model JSON output must be an object"
UNWRAPPED_TEXT = 'Unwrapped unexpected nested "text" object'
UNEXPECTED_FIELD = "unexpected top-level field: "
MISSING_FIELD = "missing required field: "
TYPE_ERRORS = {
    "document_type": "document_type must be a string or null",
    "fields": "fields must be an object",
    "tables": "tables must be a list",
    "summary": "summary must be a string or null",
    "confidence": "confidence must be a number or null",
}
NO_DOCUMENT_TYPE = "No known document type found in model output"
NO_KEY_VALUES = "No key-value pairs found in model output"
NO_TABLE_ROWS = "No table rows found in model output"
NO_SUMMARY = "Model produced no summary text"
NO_ANSWER = "Model gave no answer visible in the document"
PROMPT_REQUIRED = "prompt must be a non-empty string"
IMAGE_REQUIRED = "An image_path or image is required"
QUESTION_REQUIRED = "question is required for the question_answering task"
UNSUPPORTED_TASK = "Unsupported task '{}'"
NO_PAGES = "Document has no pages to process"
PAGE_NOT_FOUND = "Page {} not found in document"
SUMMARY_NOTE = "No numerical summarization quality score in this phase."

# ---- Fixed values: accepted file extensions and their file types ---------------------------
FILE_TYPES = {".pdf": "pdf", ".png": "png", ".jpg": "jpg", ".jpeg": "jpeg"}


def sql_text(value: str) -> str:
    """A SQL string literal.  Constants go to the parser as text: one call each, where
    building them value by value costs a driver round trip per element."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def string_array(values) -> Column:
    """Literal ``array<string>`` (typed even when empty)."""
    return F.expr(f"cast(array({', '.join(map(sql_text, values))}) as array<string>)")


def literal_map(mapping: dict[str, str]) -> Column:
    return F.expr(f"map({', '.join(sql_text(x) for pair in mapping.items() for x in pair)})")


def schema_fields(document_type: Column) -> Column:
    """Ordered field names of a document type; NULL when the type is not a known one."""
    column = F.when(document_type.isNull(), string_array(()))
    normalised = F.lower(F.trim(document_type))
    for name, fields in DOCUMENT_SCHEMAS.items():
        column = column.when(normalised == name, string_array(fields))
    return column


def _rows(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def dim_schema(spark: SparkSession) -> DataFrame:
    return _rows(
        spark,
        [(t, i, f) for t, fields in DOCUMENT_SCHEMAS.items() for i, f in enumerate(fields)],
        "document_type string, ordinal int, field string",
    )


def dim_field_alias(spark: SparkSession) -> DataFrame:
    return _rows(spark, list(FIELD_ALIASES.items()), "alias string, field string")


def dim_type_phrase(spark: SparkSession) -> DataFrame:
    return _rows(
        spark,
        [(p, t, i) for i, (t, ps) in enumerate(TYPE_PHRASES.items()) for p in ps],
        "phrase string, document_type string, ordinal int",
    )


def dim_task(spark: SparkSession) -> DataFrame:
    return _rows(
        spark,
        [("object", i, t) for i, t in enumerate(OBJECT_TASKS)]
        + [("analysis", i, t) for i, t in enumerate(ANALYSIS_TASKS)],
        "family string, ordinal int, task string",
    )
