"""Named queries over the given tables; ``fixtures/oracle.py`` holds their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.fixtures import render
from docsieve.functions import dims
from docsieve.functions.text import reply_strip_chat
from docsieve.functions.phrases import PhraseTable
from docsieve.operators import coordinates, infer, ocr, prompts, queue, replies, scoring, structured, tasks, workqueue
from docsieve.plans import analyze, report, understand
from docsieve.session import scratch_dir
from docsieve.sources import clustered, files, manifest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

REQUESTED_TASKS = (" Classification ", "KEY_VALUE_EXTRACTION", "table_extraction", "Summarization\n", "question_answering", "forgery_detection")
LOG_TIME = "2024-01-01 00:00:00"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _field_replies(spark, sf):
    return render.field_replies(render.source_documents(spark, sf))


# ---- files, words, pages ----------------------------------------------------------------------

@query
def manifest_validate(spark, sf):
    return manifest.manifest_validate(render.files(spark, sf))


@query
def manifest_reject_counts(spark, sf):
    checked = manifest.manifest_validate(render.files(spark, sf))
    return manifest.quarantine(checked).groupBy("reason").agg(
        F.count(F.lit(1)).alias("files"), F.sum("file_size_bytes").alias("bytes"))


def _scanned(spark, sf, signatures):
    folder = scratch_dir(spark, "inbox")
    render.write_document_files(spark, sf, folder)
    return manifest.manifest_scan(spark, folder, signatures, folders=3, files=100)


@query
def manifest_scan(spark, sf):
    """The documents written as files, hidden names too, and listed again."""
    files = _scanned(spark, sf, False)
    below = F.array_join(F.slice(F.split("source_path", "/"), -2, 2), "/")
    return files.select(below.alias("path"), "file_size_bytes", F.col("modified_at").isNotNull().alias("dated"))


@query
def signature_check(spark, sf):
    checked = manifest.signature_check(_scanned(spark, sf, True).filter(~F.col("source_path").endswith(".txt")))
    return checked.select(manifest.filename(F.col("source_path")).alias("filename"), "head", "signature_ok")


@query
def truth_source(spark, sf):
    folder = scratch_dir(spark, "truth")
    render.write_truth_files(render.evaluation_truth(render.source_documents(spark, sf)), folder)
    entry = lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-")))
    return files.truth_source(spark, folder, range_bytes=1 << 16).select(
        "document_id", "document_type", F.array_join(F.array_sort(F.transform(F.map_entries("expected_fields"), entry)), ",").alias("fields"),
        F.array_join(F.flatten("expected_rows"), "|", "-").alias("cells"), F.array_join("table.columns", "|").alias("columns"), "question", "answer")


@query
def ocr_text_source(spark, sf):
    folder = scratch_dir(spark, "texts")
    key = F.col("doc_id")
    name = F.concat(F.lit("batch "), key % 5, F.lit("/doc+"), key)
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    documents = render.table(spark, sf, "documents").filter("doc_id % 4 <> 1")
    first = documents.select(F.concat(name, F.lit(".txt")).alias("name"), content.alias("content"))
    second = documents.filter("doc_id % 9 = 4").select(F.concat(name, F.lit(".ocr")).alias("name"), content.alias("content"))
    render.write_files(first.unionByName(second), folder)
    asked = render.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("file:/scans/"), name, F.lit(".png")).alias("source_path"))
    joined = files.with_ocr_text(asked, files.ocr_text_source(spark, folder), "/scans")
    return joined.select("doc_id", F.md5("ocr_text").alias("text_md5"), "ocr_error")


@query
def page_explode(spark, sf):
    return manifest.page_explode(manifest.manifest_validate(render.files(spark, sf)))


@query
def ocr_word_filter(spark, sf):
    kept = ocr.ocr_word_filter(render.ocr_words(spark, sf), min_confidence=0.5)
    return kept.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("words"), F.sum(F.length("text")).alias("chars"))


@query
def ocr_lines(spark, sf):
    lines = ocr.ocr_lines(render.ocr_words(spark, sf))
    box = {name: F.get("bbox", F.lit(i)) for i, name in enumerate(("x0", "y0", "x1", "y1"))}
    return lines.select(
        *ocr.PAGE_KEYS, *ocr.LINE_KEYS, "text", *[c.alias(n) for n, c in box.items()], "confidence", "word_count")


@query
def ocr_page_text(spark, sf):
    pages = ocr.ocr_page_text(ocr.ocr_lines(render.ocr_words(spark, sf)))
    return pages.select(*ocr.PAGE_KEYS, "text", F.size("blocks").alias("n_blocks"))


@query
def ocr_document_text(spark, sf):
    return ocr.ocr_document_text(ocr.ocr_page_text(ocr.ocr_lines(render.ocr_words(spark, sf))))


@query
def page_ocr_join(spark, sf):
    pages = ocr.ocr_page_text(ocr.ocr_lines(render.ocr_words(spark, sf)))
    joined = ocr.page_ocr_join(render.document_pages(spark, sf), pages)
    return joined.select(*ocr.PAGE_KEYS, "ocr_text", F.size("ocr_blocks").alias("n_blocks"))


@query
def page_select(spark, sf):
    pages = render.document_pages(spark, sf)
    found = ocr.page_select(pages, 3).select("document_id", "page_number", F.lit(None).cast("string").alias("error"))
    missing = ocr.page_select_errors(pages.select("document_id"), pages, 3)
    return found.unionByName(missing, allowMissingColumns=True)


@query
def ocr_json(spark, sf):
    from docsieve.sources.files import ocr_json as to_text

    pages = ocr.ocr_page_text(ocr.ocr_lines(render.ocr_words(spark, sf)))
    text = to_text(ocr.ocr_documents(pages))
    back = text.withColumn("d", F.from_json("value", "pages array<struct<page_number:int,text:string>>"))
    return back.select("document_id", F.size("d.pages").alias("pages"), F.array_join(F.transform("d.pages", lambda p: p["text"]), "\f").alias("text"))


@query
def ocr_json_sink(spark, sf):
    """Nested documents written as JSON lines and read back."""
    folder = scratch_dir(spark, "ocr-json")
    files.write_ocr_json(ocr.ocr_documents(ocr.ocr_page_text(ocr.ocr_lines(render.ocr_words(spark, sf)))), folder)
    back = spark.read.schema(f"document_id string, pages array<struct<page_number:int,text:string,blocks:array<{ocr.BLOCK}>,coordinate_space:string>>").json(folder)
    return back.select(
        "document_id", F.size("pages").alias("pages"), F.aggregate("pages", F.lit(0), lambda n, p: n + F.size(p["blocks"])).alias("blocks"),
        F.array_join(F.array_distinct(F.transform("pages", lambda p: p["coordinate_space"])), ",").alias("spaces"))


@query
def ocr_clustered(spark, sf):
    """Document texts of words stored by document, without an exchange after the write."""
    folder = scratch_dir(spark, "words")
    table = "words_" + folder.rsplit("-", 1)[1]
    # a bucket for each task that the words lie in: the write moves none of them, and no bucket outgrows a task
    clustered.write_words(render.ocr_words(spark, sf), table, render.word_tasks(spark, sf), folder)
    return clustered.clustered_text(spark, table)[2]


@query
def ocr_boxes_original(spark, sf):
    lines = ocr.ocr_lines(render.ocr_words(spark, sf))
    moved = coordinates.to_space(lines, coordinates.page_transforms(render.page_sizes(spark, sf)))
    box = {name: F.get("bbox", F.lit(i)) for i, name in enumerate(("x0", "y0", "x1", "y1"))}
    return moved.select(*ocr.PAGE_KEYS, *ocr.LINE_KEYS, *[c.alias(n) for n, c in box.items()], "coordinate_space", "space_error")


@query
def ocr_mixed_spaces(spark, sf):
    """Every third line's words claim the original's space: pages and documents with both have no space."""
    words = render.ocr_words(spark, sf)
    space = F.when((F.col("line_num") + F.col("block_num")) % 3 == 0, coordinates.ORIGINAL).otherwise(coordinates.PREPARED)
    pages = ocr.ocr_page_text(ocr.ocr_lines(words.withColumn("coordinate_space", space)))
    return pages.select(*ocr.PAGE_KEYS, "coordinate_space", "space_error")


# ---- work queue and prompts ----------------------------------------------------------------------

def _asked_documents(spark, sf):
    asked = F.when(F.col("k") % 3 != 0, F.concat(F.lit(" Who signed "), F.col("document_id"), F.lit("? ")))
    return render.source_documents(spark, sf).select(
        "document_id", "document_type", asked.alias("question"),
        F.concat(F.lit("/scan/"), F.col("document_id"), F.when(F.col("k") % 11 == 5, ".unreadable").otherwise(".png")).alias("image_path"),
        F.when(F.col("k") % 4 == 0, F.concat(F.lit(" seen: "), F.col("document_type"), F.lit("\n"))).alias("ocr_text"))


def _queue(spark, sf):
    return queue.task_fanout(_asked_documents(spark, sf), REQUESTED_TASKS)


@query
def task_fanout(spark, sf):
    return _queue(spark, sf).select("document_id", "task", "document_type_hint", "status", "reason")


@query
def prompt_task(spark, sf):
    prompted = prompts.prompt_task(queue.accepted(_queue(spark, sf)))
    return prompted.select("document_id", "task", F.md5("prompt").alias("prompt_md5"), "ocr_context_used")


def _object_pages(spark, sf):
    pages = ocr.ocr_page_text(ocr.ocr_lines(render.ocr_words(spark, sf)))
    joined = ocr.page_ocr_join(render.document_pages(spark, sf), pages)
    names = dims.string_array(dims.OBJECT_TASKS)
    return joined.withColumn("task", F.get(names, F.col("page_number") % len(dims.OBJECT_TASKS)))


@query
def prompt_object(spark, sf):
    return prompts.prompt_object(_object_pages(spark, sf)).select(
        *ocr.PAGE_KEYS, "task", F.md5("prompt").alias("prompt_md5"), F.size("ocr_blocks").alias("n_blocks"))


@query
def prompt_baseline(spark, sf):
    names = ("describe", " Classify", "key_value", "QA", "document_qa", "poem")
    requests = render.table(spark, sf, "customer").select(
        "c_custkey", F.explode(dims.string_array(names)).alias("prompt_name"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Who is "), F.col("c_name"), F.lit("? "))).alias("question"))
    return prompts.prompt_baseline(requests).select(
        "c_custkey", "prompt_name", F.md5("prompt").alias("prompt_md5"), "error")


# ---- replies to JSON ------------------------------------------------------------------------------

def _chat(spark, sf):
    turn, text = F.col("turn"), F.col("text")
    prompt = F.concat(F.lit("Question "), F.col("conv_id"), F.lit("."))
    decoded = (
        F.when(turn % 4 == 0, F.concat(F.lit("User: hi\nAssistant: old\nAssistant: "), text, F.lit("\n")))
        .when(turn % 4 == 1, F.concat(F.lit("<|im_start|>user hi <|im_start|>assistant\n"), text))
        .when(turn % 4 == 2, F.concat(F.lit("<image> "), prompt, F.lit("  "), text))
        .otherwise(F.concat(F.lit("\t"), text, F.lit("  \n")))
    )
    return render.table(spark, sf, "conversations").select("conv_id", "turn", prompt.alias("prompt"), decoded.alias("decoded"))


@query
def reply_strip_chat_query(spark, sf):
    return _chat(spark, sf).select("conv_id", "turn", reply_strip_chat(F.col("decoded"), F.col("prompt")).alias("response"))


QUERIES["reply_strip_chat"] = QUERIES.pop("reply_strip_chat_query")


@query
def json_candidates(spark, sf):
    both = _field_replies(spark, sf).select("document_id", "response").unionByName(
        render.several_replies(render.source_documents(spark, sf)).select(F.concat(F.lit("several "), "document_id").alias("document_id"), "response"))
    return replies.json_candidates(both).select("document_id", "pos", "candidate")


@query
def json_candidates_sql(spark, sf):
    """The table function in SQL, joined laterally."""
    replies.register_functions(spark)
    several = render.several_replies(render.source_documents(spark, sf))
    return spark.sql("SELECT r.document_id, c.pos, c.candidate FROM {several} r, LATERAL json_candidates(r.response) c", several=several)


@query
def json_first_valid(spark, sf):
    return replies.json_first_valid(_field_replies(spark, sf)).select(
        "document_id", "candidate_pos", "payload_kind", "json_error")


@query
def json_entries(spark, sf):
    return replies.json_entries(_field_replies(spark, sf)).select("document_id", "pos", "key", "kind")


# ---- structured objects ----------------------------------------------------------------------------

@query
def structured_parse(spark, sf):
    parsed = structured.structured_parse(_field_replies(spark, sf))
    value = lambda key: F.try_element_at("fields", F.lit(key))
    return parsed.select(
        "document_id", "document_type", "summary", "parse_success", "schema_valid", "schema_normalized", "field_count",
        F.size("schema_errors").alias("n_schema_errors"), F.get("parse_errors", F.lit(0)).alias("parse_error"),
        value("invoice_number").alias("invoice_number"), value("date").alias("invoice_date"), value("amount").alias("amount"))


@query
def schema_errors(spark, sf):
    parsed = structured.structured_parse(_field_replies(spark, sf))
    return structured.schema_errors_long(parsed, "document_id")


@query
def schema_error_counts(spark, sf):
    parsed = structured.structured_parse(_field_replies(spark, sf).withColumn("variant", F.col("k") % 10))
    return structured.schema_errors_long(parsed, "variant").groupBy("variant", "error").agg(F.count(F.lit(1)).alias("replies"))


@query
def schema_rates(spark, sf):
    parsed = structured.structured_parse(_field_replies(spark, sf).withColumn("variant", F.col("k") % 10))
    return structured.schema_rates(parsed, "variant")


@query
def fields_long(spark, sf):
    parsed = structured.structured_parse(_field_replies(spark, sf))
    return structured.fields_long(parsed, "document_id")


@query
def inference_log(spark, sf):
    length = F.regexp_extract("props", "[0-9]+", 0)
    reply = F.concat(
        F.lit('{"document_type":"event","fields":{"k":'), length, F.lit(',"type":"'), F.col("event_type"),
        F.lit('","empty":"","none":null},"tables":[],"summary":null}'))
    failed = F.col("event_id") % 20 == 0
    calls = render.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), F.col("event_type").alias("task"),
        F.lit("echo").alias("model_name"), F.when(~failed, F.col("value")).alias("inference_time"),
        length.cast("int").alias("ocr_chars"), F.when(~failed, reply).alias("response"), "ts")
    log = structured.inference_log(structured.structured_parse(calls), ocr_text_length="ocr_chars", timestamp=F.lit(LOG_TIME).cast("timestamp"))
    return log.select(
        "document_id", "page_number", "model_id", "task", "latency_seconds", "parse_success", "schema_valid", "schema_normalized",
        "document_type", "number_of_extracted_fields", "ocr_text_length",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("logged_at"),
        F.size("parse_errors").alias("n_parse_errors"), F.size("schema_errors").alias("n_schema_errors"))


# ---- task family ------------------------------------------------------------------------------------

def _type_replies(spark, sf):
    documents = render.source_documents(spark, sf)
    return documents.select("document_id", F.col("document_type").alias("expected"), "k", render.type_reply().alias("response"))


@query
def classify_reply(spark, sf):
    return tasks.classify_reply(_type_replies(spark, sf)).select(
        "document_id", "document_type", "parse_success", F.get("parse_errors", F.lit(0)).alias("parse_error"))


@query
def classify_reply_table(spark, sf):
    """Phrases from a table: the fixed ones, and one of each part, which no reply holds."""
    fixed = dims.dim_type_phrase(spark)
    parts = render.table(spark, sf, "part").select(F.lower(F.concat_ws(" ", F.lit("part"), "p_partkey", "p_name")).alias("phrase"), F.lit("part").alias("document_type"), F.lit(9).alias("ordinal"))
    book = PhraseTable(fixed.unionByName(parts), shard=1000)
    return tasks.classify_reply(_type_replies(spark, sf), phrases=book).select(
        "document_id", "document_type", "parse_success", F.get("parse_errors", F.lit(0)).alias("parse_error"))


@query
def kv_wide(spark, sf):
    return tasks.kv_wide(_field_replies(spark, sf), "invoice").drop("k", "document_type", "document_type_hint")


@query
def kv_wide_statements(spark, sf):
    return tasks.kv_wide(_field_replies(spark, sf), "bank_statement").drop("k", "document_type", "document_type_hint")


@query
def kv_long(spark, sf):
    return tasks.kv_long(_field_replies(spark, sf)).select("document_id", "field", "value")


@query
def kv_dense(spark, sf):
    return tasks.kv_dense(_field_replies(spark, sf)).select("document_id", "ordinal", "field", "value")


@query
def kv_additional(spark, sf):
    return tasks.kv_additional(_field_replies(spark, sf)).select("document_id", "field", "value")


@query
def table_cells_json(spark, sf):
    return tasks.cells_long(render.ledger_replies(render.ledgers(spark, sf)))


@query
def table_cells_pipe(spark, sf):
    return tasks.cells_long(render.statement_replies(render.statements(spark, sf)))


@query
def summary_parse(spark, sf):
    text, v = F.col("text"), F.col("doc_id") % 3
    reply = (
        F.when(v == 0, F.concat(F.lit("```text\n"), text, F.lit("\n```")))
        .when(v == 1, F.to_json(F.struct(text.alias("summary"))))
        .otherwise(F.concat(F.lit("  \""), text, F.lit("...\"\n")))
    )
    documents = render.table(spark, sf, "documents").select("doc_id", reply.alias("response"))
    return tasks.summary_parse(documents).select("doc_id", "summary", "parse_success")


def _answers(spark, sf):
    """Answers about the amount of an order: one scan of three columns."""
    truth = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    asked = render.table(spark, sf, "orders").select(
        F.concat(F.lit("ORD-"), "o_orderkey").alias("document_id"), F.col("o_orderkey").alias("k"), truth.alias("expected"))
    read = F.when(F.col("k") % 7 == 3, F.concat("expected", F.lit("9"))).otherwise(F.col("expected"))
    return asked.withColumn("response", render.answer_reply(read))


@query
def qa_parse(spark, sf):
    return tasks.qa_parse(_answers(spark, sf)).select(
        "document_id", "answer", "parse_success", F.get("parse_errors", F.lit(0)).alias("parse_error"))


def _runs(spark, sf):
    truth = render.evaluation_truth(render.source_documents(spark, sf))
    return report.score_runs(render.evaluation_replies(truth), truth)


@query
def task_dispatch(spark, sf):
    truth = render.evaluation_truth(render.source_documents(spark, sf))
    parsed = tasks.task_dispatch(render.evaluation_replies(truth))
    return parsed.groupBy("task", "status").agg(
        F.count(F.lit(1)).alias("replies"), F.count_if("parse_success").alias("parsed"),
        F.sum(F.size("parse_errors")).alias("errors"),
        F.count("document_type").alias("typed"), F.count("summary").alias("summaries"), F.count("answer").alias("answers"),
        F.sum(F.coalesce(F.size("table.rows"), F.lit(0))).alias("table_rows"))


# ---- scoring ---------------------------------------------------------------------------------------------

@query
def classification_accuracy(spark, sf):
    documents = render.source_documents(spark, sf)
    predicted = tasks.classify_reply(_type_replies(spark, sf)).select("document_id", F.col("document_type").alias("predicted"))
    pairs = predicted.join(documents.select("document_id", F.col("document_type").alias("expected")), "document_id")
    return scoring.classification_accuracy(pairs, "predicted", "expected", "expected")


def _per_document(spark, sf):
    documents = render.source_documents(spark, sf)
    predicted = tasks.parse_key_value(render.field_replies(documents))
    return scoring.field_accuracy_doc(predicted, render.truth_fields(documents))


@query
def field_accuracy_doc(spark, sf):
    entry = lambda e: F.concat(e["key"], F.lit("="), F.when(e["value"], "1").otherwise("0"))
    per_field = F.array_join(F.transform(F.map_entries("per_field"), entry), ",")
    return _per_document(spark, sf).withColumn("per_field", per_field)


@query
def field_accuracy_by_type(spark, sf):
    return scoring.field_accuracy_micro(_per_document(spark, sf))


@query
def norm_match(spark, sf):
    from docsieve.functions.text import norm_match as comparable

    return render.table(spark, sf, "documents").select("doc_id", comparable(F.col("text")).alias("comparable"))


def _table_scores(spark, sf):
    ledger, statement = render.ledgers(spark, sf), render.statements(spark, sf)
    truth = ledger.select("document_id", "expected_rows").unionByName(statement.select("document_id", "expected_rows"))
    replied = render.ledger_replies(ledger).unionByName(render.statement_replies(statement))
    return scoring.table_accuracy(tasks.table_parse(replied), truth)


@query
def table_accuracy(spark, sf):
    return _table_scores(spark, sf)


@query
def table_accuracy_micro(spark, sf):
    return scoring.table_accuracy_micro(_table_scores(spark, sf).withColumn("family", F.substring("document_id", 1, 3)), "family")


@query
def qa_exact_match(spark, sf):
    answers = tasks.qa_parse(_answers(spark, sf).select("document_id", "response")).select("document_id", F.col("answer").alias("predicted"))
    truth = _answers(spark, sf).select("document_id", "k", "expected")
    pairs = answers.join(truth, "document_id").withColumn("variant", F.col("k") % 5)
    return scoring.qa_exact_match(pairs, "predicted", "expected", "variant")


def _strict(spark, sf):
    documents = render.source_documents(spark, sf)
    samples = render.truth_fields(documents).select(
        F.col("document_id").alias("sample_id"), F.concat(F.lit(" "), F.upper("document_type")).alias("expected_document_type"), "expected_fields",
        F.when(F.col("k") % 2 == 0, "Plain record ").alias("corrected_text"))
    parsed = structured.structured_parse(render.field_replies(documents)).select(
        F.col("document_id").alias("sample_id"), F.lit("echo").alias("model"), F.concat(F.lit("v"), F.col("k") % 10).alias("dataset"),
        F.lit("document_understanding").alias("task"), "document_type", "field_entries", "summary",
        "parse_success", "schema_valid", "schema_normalized", "field_count")
    return scoring.strict_metrics(parsed, samples)


@query
def strict_metrics(spark, sf):
    return _strict(spark, sf).withColumn("score", F.round("score", 6))


@query
def bench_summary(spark, sf):
    return scoring.bench_summary(_strict(spark, sf)).withColumn("mean_score", F.round("mean_score", 6))


@query
def bench_cube(spark, sf):
    cube = scoring.bench_cube(_strict(spark, sf), listed=3)
    lowest = F.transform("lowest", lambda r: F.concat(r["sample_id"], F.lit("="), F.format_number(r["score"], 4)))
    return cube.withColumn("mean_score", F.round("mean_score", 6)).withColumn("lowest", F.array_join(lowest, ","))


def _timed_runs(spark, sf):
    failed = F.col("event_id") % 20 == 0
    return render.table(spark, sf, "events").select(
        "event_id", "event_type", F.when(failed, "FAILED").otherwise("RUN").alias("status"), F.when(~failed, F.col("value")).alias("inference_time"))


@query
def latency_summary(spark, sf):
    return scoring.latency_summary(_timed_runs(spark, sf), "event_type")


@query
def latency_quantiles(spark, sf):
    """Sketches of 50 runs, kept apart and merged per event type, held against the exact ranks."""
    runs = _timed_runs(spark, sf).withColumn("run", F.col("event_id") % 50)
    estimates = scoring.latency_quantiles(scoring.latency_sketches(runs, "run", "event_type"), "event_type")
    names = [f"p{q * 100:g}_seconds" for q in scoring.QUANTILES]
    # an estimate's true rank lies between the share of times below it and of times up to it
    at = runs.filter("status = 'RUN' and inference_time <> 0").join(estimates, "event_type")
    share = lambda found: F.count_if(found) / F.count(F.lit(1))
    close = [((share(F.col("inference_time") < F.col(n)) <= q + scoring.SKETCH_ERROR) & (share(F.col("inference_time") <= F.col(n)) >= q - scoring.SKETCH_ERROR)).alias(
        n.replace("_seconds", "_close")) for n, q in zip(names, scoring.QUANTILES)]
    return at.groupBy("event_type").agg(F.first("timed_runs").alias("timed_runs"), *close)


@query
def run_status(spark, sf):
    truth = render.evaluation_truth(render.source_documents(spark, sf))
    return scoring.run_status(render.evaluation_replies(truth), "task")


# ---- inference and whole runs ---------------------------------------------------------------------------

@query
def batch_infer(spark, sf):
    prompted = prompts.prompt_task(queue.accepted(_queue(spark, sf)))
    done = infer.batch_infer(prompted.select("document_id", "task", "image_path", "prompt"), infer.echo_predictor_factory(), "echo")
    return done.select("document_id", "task", "status", "error", "response", "model_name", "device", "inference_time")


@query
def infer_resumed(spark, sf):
    """A run over two tasks, then one over all that asks for the rest only; unreadable images are asked three times."""
    prompted = prompts.prompt_task(queue.accepted(_queue(spark, sf))).select("document_id", "task", "image_path", "prompt")
    path, model = scratch_dir(spark, "answers"), infer.echo_predictor_factory()
    workqueue.run_queue(prompted.filter(F.col("task").isin(dims.CLASSIFICATION, dims.SUMMARY)), path, model, "echo", flush_rows=1 << 14)
    done = workqueue.run_queue(prompted, path, model, "echo", flush_rows=1 << 14)
    return done.select("document_id", "task", "status", "error", "response", "inference_time", "attempts")


def counting_reply(image_ref: str, prompt: str) -> str:
    n = len(prompt)
    return f'{{"document_type":"invoice","fields":{{"Prompt chars":{n}}},"columns":["n"],"rows":[[{n}]],"summary":"{n} chars.","answer":"{n}"}}'


@query
def analyze_documents(spark, sf):
    done = analyze.analyze_documents(
        _asked_documents(spark, sf), infer.echo_predictor_factory(reply=counting_reply), dims.string_array(REQUESTED_TASKS), model_key="counting")
    parts = [
        "status", "error", "document_type", F.col("ocr_context_used").cast("string"), F.round(F.col("inference_time") * 1000).cast("bigint").cast("string"),
        F.col("parse_success").cast("string"), F.try_element_at("additional_fields", F.lit("prompt_chars")),
        F.get(F.get("table.rows", F.lit(0)), F.lit(0)), "summary", "answer"]
    line = F.concat_ws("|", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("-")) for p in parts])
    return done.select("document_id", "task", F.md5(line).alias("envelope_md5"))


@query
def eval_runs(spark, sf):
    return _runs(spark, sf).select(
        "document_id", "task", "status", "expected_document_type", "document_type", "parse_success", "label_correct",
        "total_fields", "correct_fields", "expected_rows", "correct_rows", "total_cells", "correct_cells", "field_accuracy")


@query
def report_sink(spark, sf):
    """Two runs written, then two tasks of the first once more: these are replaced, all else stays."""
    path, columns = scratch_dir(spark, "runs"), ("document_id", "task", "status", "label_correct")
    runs = _runs(spark, sf).select(*columns)
    files.write_runs(runs, path, "first")
    files.write_runs(runs.filter("status = 'RUN'"), path, "second")
    files.write_runs(runs.filter(F.col("task").isin(dims.CLASSIFICATION, dims.QA)).withColumn("status", F.concat(F.lit("again "), "status")), path, "first")
    back = files.read_runs(spark, path, "document_id string, status string, label_correct boolean, task string")
    return back.groupBy("run_id", "task", "status").agg(F.count(F.lit(1)).alias("runs"), F.count_if("label_correct").alias("correct"))


@query
def eval_report(spark, sf):
    nested = report.eval_report(_runs(spark, sf), "echo", {"device": "cpu"})
    m = "metrics."
    return nested.select(
        "status", "model", "documents_evaluated", F.size("tasks_evaluated").alias("tasks"),
        *[F.col(f"{m}{group}.{name}").alias(f"{prefix}_{name}") for group, prefix, names in (
            ("classification", "class", ("total", "correct", "accuracy")),
            ("key_value_extraction", "kv", ("total_fields", "correct_fields", "accuracy")),
            ("table_extraction", "table", ("expected_rows", "correct_rows", "row_accuracy", "total_cells", "correct_cells", "cell_accuracy")),
            ("question_answering", "qa", ("total", "correct", "exact_match")),
        ) for name in names],
        *[F.col(f"inference_time_seconds.{name}").alias(f"time_{name}") for name in ("runs", "total", "mean", "min", "max")])


def letter_reply(image_ref: str, prompt: str) -> str:
    if image_ref.endswith(".PNG"):
        return "I can only describe this picture."
    summary = "null" if prompts.NO_OCR_TEXT in prompt else '"page with text"'
    return f'{{"document_type":"letter","fields":{{"source":"{image_ref}"}},"tables":[],"summary":{summary}}}'


@query
def understand_documents(spark, sf):
    known = manifest.accepted(manifest.manifest_validate(render.files(spark, sf)))
    # the id that the words lie by is the one that they are grouped by
    words = render.ocr_words(spark, sf, manifest.document_id(render.file_path(F.col("doc_id"))))
    done = understand.understand_documents(
        known, words, "document_understanding", infer.echo_predictor_factory(reply=letter_reply), model_key="letter")
    total = lambda column, value: F.aggregate(column, F.lit(0), lambda acc, x: acc + value(x))
    return done.select(
        "document_id", "task", "model_id", "metadata.filename", F.size("results").alias("pages"),
        total("results", lambda r: r["parse_success"].cast("int")).alias("parsed"),
        total("inference_logs", lambda r: r["field_count"]).alias("fields"),
        total("inference_logs", lambda r: r["ocr_text_length"]).alias("ocr_chars"),
        total("ocr", lambda p: F.size(p["blocks"])).alias("blocks"),
        F.array_join(F.transform("results", lambda r: F.coalesce(r["summary"], F.lit("-"))), ",").alias("summaries"))


@query
def understand_errors(spark, sf):
    """Every second PDF comes without a page count, and only second pages are asked for."""
    listed = render.files(spark, sf)
    counted = listed.withColumn("page_count", F.when(F.col("file_size_bytes") % 2 == 0, F.col("page_count")))
    return understand.understand_errors(manifest.manifest_validate(counted), 2)


@query
def eval_unmatched(spark, sf):
    """Replies of the labelled documents against the truth of those with an even id."""
    replies = render.table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"))
    truth = render.table(spark, sf, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("document_id"))
    return report.eval_unmatched(replies, truth)
