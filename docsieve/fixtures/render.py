"""Documents, ground truth, recognised words and replies derived from the given tables.

Every reply is written from a known row in one of ten shapes (``k % 10``), so expected
results follow from the row and the shape alone.  Group keys are unique ids, or blocks of
consecutive unique ids: a user with a third of all events gets many bounded statements
instead of one endless one.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from docsieve.functions import dims
from docsieve.sources.remote import opened

EVENT_BLOCK = 1000   # events per statement at most (event ids are unique)
LEDGER_BLOCK = 8     # orders per ledger
DOCUMENTS_PER_TASK = 50_000
TEXTS_PER_TASK = 4_000  # a text is hundreds of words
PART_SPACE = 10**15  # above every part key

LABELS = {  # how replies with free field names call the fields, in schema order
    "invoice": ("Invoice No", "Customer Name", "Invoice Date", "Item Name", "Qty", "Total Amount"),
    "bank_statement": ("Account Holder", "Period", "Date of Transaction", "Description", "Withdrawal", "Deposit", "Closing Balance"),
    "salary_slip": ("Emp Name", "Emp ID", "Pay Month", "Basic Pay", "Allowance", "Deduction", "Net Pay"),
    "identity_document": ("Document Type", "Full Name", "ID Number", "DOB", "Valid Until"),
}
PHRASES = {"invoice": "tax invoice", "bank_statement": "account statement", "salary_slip": "payslip", "identity_document": "passport"}
OTHERS = {"invoice": "payslip", "bank_statement": "invoice", "salary_slip": "passport", "identity_document": "bank statement"}
TOKENS = ("N/A", "<value>", "--", "Unknown.")
COMPANY = "Acme"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(column: Column) -> Column:
    return column.cast("decimal(18,2)")


def _day(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def _document(df: DataFrame, document_type: str, document_id: Column, k: Column, values: list[Column]) -> DataFrame:
    return df.select(
        document_id.alias("document_id"),
        F.lit(document_type).alias("document_type"),
        k.cast("bigint").alias("k"),
        F.array(*[v.cast("string") for v in values]).alias("values"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One number instead of min_by over a struct: a fixed-width buffer keeps hash aggregation.
    first = F.min(F.col("l_linenumber").cast("bigint") * PART_SPACE + F.col("l_partkey"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), (first % PART_SPACE).alias("partkey"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(part, F.col("partkey") == F.col("p_partkey"), "left")
    )
    key = F.col("o_orderkey")
    return _document(rows, "invoice", F.concat(F.lit("ORD-"), key), key, [
        F.concat(F.lit("INV-"), key), F.col("c_name"), _day(F.col("o_orderdate")), F.col("p_name"),
        F.coalesce("n", F.lit(0)), _money(F.col("o_totalprice")),
    ])


def _statement_keys(events: DataFrame) -> DataFrame:
    amount = _money(F.col("value"))
    debit = F.col("event_id") % 2 == 1
    return events.select(
        "user_id", (F.col("event_id") / EVENT_BLOCK).cast("bigint").alias("block"), "event_id", "ts", "event_type",
        F.when(debit, amount).alias("debit"), F.when(~debit, amount).alias("credit"),
        F.when(debit, -amount).otherwise(amount).alias("signed"))


def _statement_id() -> Column:
    return F.concat(F.lit("USR-"), F.col("user_id"), F.lit("-"), F.col("block"))


def bank_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min(F.struct("ts", "event_id", "event_type", "debit", "credit")).alias("first")
    rows = _statement_keys(table(spark, sf_dir, "events")).groupBy("user_id", "block").agg(
        first, F.max("ts").alias("last_ts"), F.sum("signed").alias("balance"))
    return _document(rows, "bank_statement", _statement_id(), F.col("user_id") + F.col("block"), [
        F.concat(F.lit("User "), F.col("user_id")),
        F.concat(_day(F.col("first.ts")), F.lit(" to "), _day(F.col("last_ts"))),
        _day(F.col("first.ts")), F.col("first.event_type"), F.col("first.debit"), F.col("first.credit"),
        _money(F.col("balance")),
    ])


def salary_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    plus, minus, basic = (key % 7) * 100, (key % 5) * 50, _money(F.col("c_acctbal"))
    return _document(table(spark, sf_dir, "customer"), "salary_slip", F.concat(F.lit("EMP-"), key), key, [
        F.col("c_name"), F.concat(F.lit("EMP-"), key),
        F.concat(F.lit("2024-"), F.lpad((key % 12 + 1).cast("string"), 2, "0")),
        basic, plus, minus, _money(basic + (plus - minus).cast("decimal(10,0)")),
    ])


def identity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    after = lambda start, span: F.date_add(F.to_date(F.lit(start)), (key % span).cast("int"))
    return _document(table(spark, sf_dir, "supplier"), "identity_document", F.concat(F.lit("ID-"), key), key, [
        F.when(key % 2 == 0, "passport").otherwise("identity card"), F.col("s_name"), F.concat(F.lit("ID-"), key),
        _day(after("1960-01-01", 10000)), _day(after("2030-01-01", 3650)),
    ])


def _tasks(spark: SparkSession, at_most: int, per_task: int) -> int:
    # fewer than the joins' own number and these would deal them again
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-at_most // per_task))


def _spread(documents: DataFrame, at_most: int, per_task: int) -> DataFrame:
    """Documents dealt by their id: tasks follow the rows, not the few bytes that long replies and words grow from."""
    return documents.repartition(_tasks(documents.sparkSession, at_most, per_task), "document_id")


def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, document_type, k, values (in schema order) of all four types."""
    documents = (
        invoices(spark, sf_dir).unionByName(bank_statements(spark, sf_dir))
        .unionByName(salary_slips(spark, sf_dir)).unionByName(identity_documents(spark, sf_dir))
    )
    # a statement has an event at least; Parquet footers hold the counts
    at_most = sum(table(spark, sf_dir, name).count() for name in ("orders", "events", "customer", "supplier"))
    return _spread(documents, at_most, DOCUMENTS_PER_TASK)


def _names() -> Column:
    return dims.schema_fields(F.col("document_type"))


def _per_type(values: dict[str, tuple[str, ...]]) -> Column:
    column = F.when(F.lit(False), dims.string_array(()))
    for name, labels in values.items():
        column = column.when(F.col("document_type") == name, dims.string_array(labels))
    return column


def _misread(values: Column) -> Column:
    """Every seventh document has its last field misread."""
    last = F.size(values) - 1
    return F.when(F.col("k") % 7 == 3, F.transform(values, lambda v, i: F.when(
        i == last, F.concat(F.coalesce(v, F.lit("")), F.lit("9"))).otherwise(v))).otherwise(values)


def _json_map(names: Column, values: Column) -> Column:
    return F.to_json(F.map_from_arrays(names, values))


def _object(fields: Column, summary: str = "Plain record") -> Column:
    return F.concat(F.lit('{"document_type":"'), F.col("document_type"), F.lit('","fields":'), fields,
                    F.lit(f',"tables":[],"summary":"{summary}"}}'))


def field_reply() -> Column:
    """Key-value / structured reply text for rows of ``source_documents``."""
    names, labels, values = F.col("_names"), F.col("_labels"), F.col("_values")
    fields = _json_map(names, values)
    nulled = F.transform(values, lambda v, i: F.when(
        i % 2 == 1, F.element_at(dims.string_array(TOKENS), ((i + F.col("k")) % len(TOKENS) + 1).cast("int"))).otherwise(v))
    at = lambda i: F.get(values, F.lit(i))
    flat_invoice = F.to_json(F.create_map(
        F.lit("document_type"), F.lit("invoice"), F.lit("invoice_number"), at(0), F.lit("date"), at(2),
        F.lit("customer_name"), at(1), F.lit("company"), F.lit(COMPANY), F.lit("total_amount"), at(5)))
    one_key_objects = F.array_join(F.transform(F.arrays_zip(names.alias("n"), values.alias("v")), lambda e: F.to_json(
        F.create_map(e["n"], e["v"]))), ",")
    text_lines = F.array_join(F.concat(
        F.transform(F.arrays_zip(labels.alias("l"), values.alias("v")), lambda e: F.concat(
            e["l"], F.lit(": "), F.coalesce(e["v"], F.lit("")))),
        F.array(F.lit("- Remark = checked"))), "\n")
    stale = F.concat(F.lit('{"'), F.get(names, F.lit(0)), F.lit('":"stale",'), F.substring(fields, 2, 1 << 30))
    v = F.col("k") % 10
    return (
        F.when(v == 0, _object(fields))
        .when(v == 1, F.concat(F.lit("Here is the result.\n```json\n"), _object(fields), F.lit("\n```\nDone.")))
        .when(v == 2, F.when(F.col("document_type") == "invoice", flat_invoice).otherwise(_json_map(labels, values)))
        .when(v == 3, F.concat(F.lit('{"text":'), _object(fields), F.lit("}")))
        .when((v == 4) & (F.col("k") % 20 == 4), F.concat(
            F.lit('{"document_type":"cut","fields":'), F.expr("substring(_fields, 1, length(_fields) - 1)")))
        .when(v == 4, F.concat(F.lit('{"document_type":"cut","fields":'), fields, F.lit(',"tables":[')))
        .when(v == 5, text_lines)
        .when(v == 6, F.lit("The page is too blurred to read any of it"))
        .when(v == 7, _object(F.concat(F.lit("["), one_key_objects, F.lit("]"))))
        .when(v == 8, _object(_json_map(names, nulled)))
        .otherwise(F.concat(_object(stale, "uses } and { inside"), F.lit("\nThat is all {sic")))
    )


def field_replies(documents: DataFrame) -> DataFrame:
    """document_id, document_type, k, document_type_hint, response."""
    staged = (
        documents.withColumn("_names", _names()).withColumn("_labels", _per_type(LABELS))
        .withColumn("_values", _misread(F.col("values")))
        .withColumn("_fields", _json_map(F.col("_names"), F.col("_values")))
    )
    return staged.select(
        "document_id", "document_type", "k", F.col("document_type").alias("document_type_hint"), field_reply().alias("response"))


def truth_fields(documents: DataFrame) -> DataFrame:
    return documents.select(
        "document_id", "document_type", "k", F.map_from_arrays(_names(), F.col("values")).alias("expected_fields"))


def type_reply() -> Column:
    phrase = F.try_element_at(dims.literal_map(PHRASES), F.col("document_type"))
    other = F.try_element_at(dims.literal_map(OTHERS), F.col("document_type"))
    v = F.col("k") % 6
    return (
        F.when(v == 0, F.concat(F.lit("This looks like a "), F.upper(phrase), F.lit(".")))
        .when(v == 1, F.concat(F.lit('{"document_type": "'), F.col("document_type"), F.lit('"}')))
        .when(v == 2, F.concat(F.lit('{"note": "not a '), other, F.lit('", "type": "'), phrase, F.lit('"}')))
        .when(v == 3, F.lit("A photo of a cat."))
        .when(v == 4, F.concat(F.lit("Clearly a "), other, F.lit(", not a "), phrase, F.lit(".")))
        .otherwise(F.lit(""))
    )


def answer_reply(answer: Column) -> Column:
    v = F.col("k") % 5
    return (
        F.when(v == 0, F.concat(F.lit('{"answer": "'), answer, F.lit('"}')))
        .when(v == 1, F.concat(answer, F.lit(".")))
        .when(v == 2, F.lit("Not visible in document."))
        .when(v == 3, F.concat(F.lit('```json\n{"answer": "'), answer, F.lit('"}\n```')))
        .otherwise(F.concat(F.lit('"'), answer, F.lit('"')))
    )


# ---- tables ---------------------------------------------------------------------------------

LEDGER_COLUMNS = ("Order", "Date", "Status", "Amount")
STATEMENT_COLUMNS = ("Date", "Description", "Debit", "Credit", "Balance")


def ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, k, expected_rows and read_rows of blocks of consecutive orders."""
    key = F.col("o_orderkey")
    amount = _money(F.col("o_totalprice")).cast("string")
    cells = lambda last: F.array(F.concat(F.lit("ORD-"), key), _day(F.col("o_orderdate")), F.col("o_orderstatus"), last)
    misread = F.when(key % 7 == 3, F.concat(amount, F.lit("9"))).otherwise(amount)
    rows = table(spark, sf_dir, "orders").select(
        (key / LEDGER_BLOCK).cast("bigint").alias("k"),
        F.struct(key.alias("at"), cells(amount).alias("true"), cells(misread).alias("read")).alias("row"))
    return _tables(rows, F.concat(F.lit("LED-"), F.col("k")), "k")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for statement blocks, with a running balance inside each block."""
    events = _statement_keys(table(spark, sf_dir, "events"))
    so_far = Window.partitionBy("user_id", "block").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    balance = _money(F.sum("signed").over(so_far)).cast("string")
    text = lambda name: F.col(name).cast("string")
    cells = lambda last: F.array(_day(F.col("ts")), F.col("event_type"), text("debit"), text("credit"), last)
    rows = events.withColumn("balance", balance).select(
        "user_id", "block",
        F.struct(
            "ts", "event_id", cells(F.col("balance")).alias("true"),
            cells(F.when(F.col("event_id") % 7 == 3, F.concat("balance", F.lit("9"))).otherwise(F.col("balance"))).alias("read"),
        ).alias("row"))
    return _tables(rows, _statement_id(), "user_id", "block").withColumn("k", F.col("user_id") + F.col("block"))


def _tables(rows: DataFrame, document_id: Column, *keys: str) -> DataFrame:
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return grouped.select(
        document_id.alias("document_id"), *keys,
        F.transform("rows", lambda r: r["true"]).alias("expected_rows"),
        F.transform("rows", lambda r: r["read"]).alias("read_rows"))


def ledger_replies(ledger: DataFrame) -> DataFrame:
    as_object = lambda r: F.struct(*[F.get(r, F.lit(i)).alias(c) for i, c in enumerate(LEDGER_COLUMNS)])
    arrays, objects = F.to_json("read_rows"), F.to_json(F.transform("read_rows", as_object))
    v = F.col("k") % 4
    reply = (
        F.when(v == 0, F.concat(
            F.lit('{"columns":["Order","Date","Status","Amount"],"rows":[["N/A","--","","<cell>"],'),
            F.substring(arrays, 2, 1 << 30), F.lit("}")))
        .when(v == 1, F.concat(F.lit('```json\n{"rows":'), objects, F.lit("}\n```")))
        .when(v == 2, F.concat(F.lit("Rows:\n```\n"), objects, F.lit("\n```")))
        .otherwise(F.concat(F.lit('Table:\n{"columns":["Order","Date","Note","Amount"],"rows":'), objects, F.lit("}\nEnd.")))
    )
    return ledger.select("document_id", "k", reply.alias("response"))


def statement_replies(statement: DataFrame) -> DataFrame:
    line = lambda cells: F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | ")
    header = dims.string_array(STATEMENT_COLUMNS)
    rule = lambda mark: F.array_repeat(F.lit(mark), len(STATEMENT_COLUMNS))
    body = lambda mark: F.concat(F.array(header, rule(mark)), F.col("read_rows"))
    boxed = lambda mark: F.array_join(F.transform(body(mark), lambda r: F.concat(F.lit("| "), line(r), F.lit(" |"))), "\n")
    v = F.col("k") % 3
    reply = (
        F.when(v == 0, boxed("---"))
        .when(v == 1, F.concat(F.lit("Transactions follow.\n\n"), boxed(":---:"), F.lit("\nEnd of the | list.")))
        .otherwise(F.array_join(F.transform(body("--"), line), "\n"))
    )
    return statement.select("document_id", "k", reply.alias("response"))


# ---- evaluation run ---------------------------------------------------------------------------

def evaluation_truth(documents: DataFrame) -> DataFrame:
    """Truth of all five tasks; the table is one row of the last three fields (none for identity)."""
    last_three = F.slice("values", -3, 3)
    return documents.select(
        "document_id", "document_type", "k", "values",
        F.concat(F.lit("/scan/"), F.col("document_id"), F.lit(".png")).alias("image_path"),
        F.map_from_arrays(_names(), F.col("values")).alias("expected_fields"),
        F.when(F.col("document_type") == "identity_document", F.array().cast("array<array<string>>"))
        .otherwise(F.array(last_three)).alias("expected_rows"),
        F.concat(F.lit("What is the "), F.element_at(_names(), -1), F.lit("?")).alias("question"),
        F.element_at("values", -1).alias("answer"),
    )


def evaluation_replies(truth: DataFrame) -> DataFrame:
    """Replies for every (document, task); every twentieth run failed."""
    staged = (
        truth.select("document_id", "document_type", "k", "values")
        .select("*", F.posexplode(dims.string_array(dims.ANALYSIS_TASKS)).alias("ordinal", "task"))
        .withColumn("_names", _names()).withColumn("_labels", _per_type(LABELS))
        .withColumn("_values", _misread(F.col("values")))
        .withColumn("_fields", _json_map(F.col("_names"), F.col("_values")))
    )
    table_reply = F.concat(
        F.lit('{"columns":'), F.to_json(F.slice("_names", -3, 3)), F.lit(',"rows":['),
        F.when(F.col("document_type") != "identity_document", F.to_json(F.slice("_values", -3, 3))).otherwise(""), F.lit("]}"))
    reply = (
        F.when(F.col("task") == dims.CLASSIFICATION, type_reply())
        .when(F.col("task") == dims.KEY_VALUE, field_reply())
        .when(F.col("task") == dims.TABLE, table_reply)
        .when(F.col("task") == dims.SUMMARY, F.concat(F.lit("Summary of "), F.col("document_id"), F.lit(".")))
        .otherwise(answer_reply(F.element_at("_values", -1)))
    )
    failed = (F.col("k") + F.col("ordinal")) % 20 == 0
    return staged.select(
        "document_id", "task",
        F.when(F.col("task") == dims.KEY_VALUE, F.col("document_type")).alias("document_type_hint"),
        F.when(failed, "FAILED").otherwise("RUN").alias("status"),
        F.when(failed, "timeout").alias("error"),
        F.when(~failed, reply).alias("response"),
        F.when(~failed, ((F.col("k") * 7 + F.col("ordinal") * 13) % 1000) / F.lit(1000)).alias("inference_time"),
    )


# ---- files and words ------------------------------------------------------------------------------

EXTENSIONS = (".pdf", ".PNG", ".jpg", ".jpeg", ".txt", "")


def file_path(key: Column) -> Column:
    suffix = F.get(dims.string_array(EXTENSIONS), (key % len(EXTENSIONS)).cast("int"))
    return F.concat(F.lit("/inbox/doc_"), key, suffix)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per document: source_path, file_size_bytes, page_count (of PDFs)."""
    key = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        file_path(key).alias("source_path"),
        F.col("n_chars").alias("file_size_bytes"), (key % 3 + 1).cast("int").alias("page_count"), key.alias("doc_id"))


def word_tasks(spark: SparkSession, sf_dir: str) -> int:
    """In how many tasks, by the hash of their document, the words of ``ocr_words`` lie."""
    return _tasks(spark, table(spark, sf_dir, "documents").count(), TEXTS_PER_TASK)


def ocr_words(spark: SparkSession, sf_dir: str, document_id: Column | None = None) -> DataFrame:
    """Recognised words of ``documents``, whole texts: one row per word.  ``document_id``: another id than ``doc_id`` as text."""
    source = table(spark, sf_dir, "documents")
    document_id = F.col("doc_id").cast("string") if document_id is None else document_id
    # lines, pages and documents of words that lie by document are grouped without an exchange: texts move, not words
    documents = _spread(source.select(document_id.alias("document_id"), "doc_id", "text"), source.count(), TEXTS_PER_TASK)
    words = documents.select("document_id", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "_line")).select(
        "document_id", "doc_id", "line", F.posexplode(F.split("_line", " ")).alias("word", "text"))
    block = F.floor(F.col("line") / 5).cast("int")
    conf = (F.col("doc_id") * 31 + F.col("line") * 13 + F.col("word") * 7) % 110 - 5
    return words.select(
        "document_id",
        (F.floor(block / 4) + 1).cast("int").alias("page_number"),
        F.col("word").alias("word_idx"),
        "text",
        F.least(conf, F.lit(100)).cast("double").alias("conf"),
        block.alias("block_num"), F.lit(1).alias("par_num"), (F.col("line") % 5).alias("line_num"), F.lit(1).alias("page_num"),
        (F.col("word") * 40).alias("left"), (F.col("line") * 20).alias("top"),
        (F.length("text") * 8).alias("width"), F.lit(16).alias("height"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of ``documents``: as many as its lines fill, and one empty page more."""
    n_lines = F.size(F.split("text", "\n"))
    last = (F.floor((n_lines - 1) / 20) + 2).cast("int")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.explode(F.sequence(F.lit(1), last)).alias("page_number"))


# ---- real files -------------------------------------------------------------------------------------

HEADS = {".pdf": "255044462D312E37", ".PNG": "89504E470D0A1A0A", ".jpg": "FFD8FFE000104A46", ".jpeg": "FFD8FFE000104A46"}
PREFIXES = ("", "_", ".")


def document_file(key: Column) -> Column:
    """Path of a document's file below its folder; some names start with ``_`` or ``.``."""
    prefix = F.get(dims.string_array(PREFIXES), (key % len(PREFIXES)).cast("int"))
    suffix = F.get(dims.string_array(EXTENSIONS), (key % len(EXTENSIONS)).cast("int"))
    return F.concat(F.lit("batch_"), key % 5, F.lit("/"), prefix, F.lit("doc_"), key, suffix)


def write_document_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """A file per document: the leading bytes of its type (every seventh has those of a PDF), then the text."""
    key = F.col("doc_id")
    suffix = F.get(dims.string_array(EXTENSIONS), (key % len(EXTENSIONS)).cast("int"))
    head = F.when(key % 7 == 3, HEADS[".pdf"]).otherwise(F.coalesce(F.try_element_at(dims.literal_map(HEADS), suffix), F.lit("")))
    write_files(table(spark, sf_dir, "documents").select(
        document_file(key).alias("name"), F.concat(F.unhex(head), F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content")), folder)


def write_files(files: DataFrame, folder: str) -> None:
    """Write (name, content) rows as files below ``folder``, in tasks."""
    def run(batches):
        system, root = opened(folder)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = f"{root}/{name}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as file:
                    file.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])
    files.mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def write_truth_files(truth: DataFrame, folder: str, files: int = 8) -> None:
    """Truth documents as ``{"documents": [...]}`` files, one a task."""
    names = F.col("expected_fields")
    document = F.to_json(F.struct(
        "document_id", "image_path", "document_type", names.alias("fields"),
        F.struct(F.slice(F.map_keys(names), -3, 3).alias("columns"), F.col("expected_rows").alias("rows")).alias("table"), "question", "answer"))

    def run(batches):
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        n = 0
        with system.open_output_stream(f"{root}/truth-{TaskContext.get().partitionId()}.json") as file:
            file.write(json.dumps({"made": {"documents": "none"}})[:-1].encode() + b', "documents": [')
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    file.write((b",\n" if n else b"") + text.encode())
                    n += 1
            file.write(b"]}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])
    truth.select(document.alias("text")).repartition(files).mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def several_replies(documents: DataFrame) -> DataFrame:
    """Replies with several candidates: a fence, objects in prose, one twice, one inside an object that stays open."""
    plain = F.to_json(F.struct(F.col("k").alias("n"), F.col("document_id").alias("id")))
    fenced = F.to_json(F.struct(F.col("document_id").alias("id"), F.col("document_type").alias("type")))
    inner = F.concat(F.lit('{"k":'), F.col("k"), F.lit(',"s":"} not the end {"}'))
    several = F.concat(F.lit("Draft "), plain, F.lit(" and\n```json\n"), fenced, F.lit("\n```\nthen again "), plain, F.lit(' {"open":'), inner)
    whole = F.concat(F.lit('{"a":'), inner, F.lit("}"))
    reply = F.when(F.col("k") % 3 == 0, several).when(F.col("k") % 3 == 1, whole).otherwise(F.concat(F.lit("none, only a } of "), F.col("document_id")))
    return documents.select("document_id", "k", reply.alias("response"))


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the pages of ``documents`` were prepared: turned by quarters, halved for even ids; every fifth document is not known."""
    pages = document_pages(spark, sf_dir)
    key = F.col("document_id").cast("bigint")
    scale = F.when(key % 2 == 0, 0.5).otherwise(1.0)
    return pages.filter(key % 5 != 0).select(
        "document_id", "page_number", F.lit(2000).alias("width"), F.lit(3000).alias("height"),
        ((key + F.col("page_number")) % 4 * 90).alias("rotation"), scale.alias("scale_x"), scale.alias("scale_y"))
