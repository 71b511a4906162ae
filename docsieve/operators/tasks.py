"""Task family: free-form replies to typed task results.

All five parsers are staged column expressions over one shredded payload per reply, so a
mixed corpus is parsed in a single scan with one Python crossing and no shuffle; CASE
WHEN picks the parser by the row's task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions import dims
from docsieve.functions.phrases import PhraseTable
from docsieve.functions.jsonreply import explode_rows, json_tree, leaves, node
from docsieve.functions.text import is_blank, let, lines, norm_field_name, norm_text, norm_value, strip

# ---- Fixed values: line and table formats ---------------------------------------------
KEY_VALUE_LINE = r"(?U)^\s*[-*•]?\s*([A-Za-z][A-Za-z0-9 _/#.()-]{0,48}?)\s*[:=]\s*(.*)$"
TABLE_RULE_CELL = r"^:?-{2,}:?$"
FENCE_MARK = "```[a-zA-Z]*"

ENTRIES = "array<struct<field:string,kind:string,value:string>>"
TABLE_TYPE = "struct<columns:array<string>,rows:array<array<string>>>"
_CONTAINERS = ("object", "array")


def _nodes() -> Column:
    return F.col("_tree.nodes")


def _is_object() -> Column:
    return F.col("_tree.kind") == "object"


def _string_member(key: str) -> Column:
    """Value of a top-level string entry of an object payload, else NULL."""
    entry = node(_nodes(), key)
    return F.when(_is_object() & (entry["kind"] == "string"), entry["value"])


def with_payload(
    replies: DataFrame, reply: str = "response", container_text: Column | bool = False, named: Column | bool | None = None, depth: Column | int = 3,
) -> DataFrame:
    """Adds ``_tree``, the payload every parser reads, shredded as ``json_tree`` says."""
    return replies.withColumn("_tree", json_tree(F.col(reply), container_text, named, depth))


# ---- classification ----------------------------------------------------------------------

def _truthy(entry: Column) -> Column:
    kind, value = entry["kind"], entry["value"]
    return (
        ((kind == "string") & (value != ""))
        | ((kind == "boolean") & (value == "True"))
        | ((kind == "number") & ~value.isin("0", "0.0", "-0.0"))
        | (kind.isin(*_CONTAINERS) & (F.size(entry["items"]) > 0))
    )


def _evidence(reply: Column) -> Column:
    """Lower-case text to search, a declared JSON type first."""
    entry = F.when(_truthy(node(_nodes(), "document_type")), node(_nodes(), "document_type"))
    declared = F.coalesce(entry, node(_nodes(), "type"))
    prefix = F.when(_is_object() & (declared["kind"] == "string"), F.concat(declared["value"], F.lit(" ")))
    return F.lower(F.concat(F.coalesce(prefix, F.lit("")), reply))


def _earliest_type(text: str) -> Column:
    """Type of the phrase found first in column ``text``; NULL when none occurs."""
    hits = []
    for ordinal, (document_type, phrases) in enumerate(dims.TYPE_PHRASES.items()):
        for phrase in phrases:
            at = f"instr({text}, {dims.sql_text(phrase)})"
            hits.append(f"if({at} > 0, struct({at} AS at, {ordinal} AS ordinal, {dims.sql_text(document_type)} AS type), NULL)")
    return F.expr(f"least({', '.join(hits)})")["type"]


# ---- key-value ---------------------------------------------------------------------------

def _line_entries(reply: Column) -> Column:
    """Key and value of every line of that form; each line meets the pattern once.

    The match is rewritten to key, mark, value.  A line without a match stays as it is, and
    no match can: a mark stands where its separator stood.
    """
    mark = "\x01"
    split = F.transform(lines(reply), lambda line: let(strip(line), lambda own: let(
        F.regexp_replace(own, KEY_VALUE_LINE, f"$1{mark}$2"), lambda new: F.when(new != own, new))))
    return F.transform(F.filter(split, lambda new: new.isNotNull()), lambda new: F.struct(
        F.substring_index(new, mark, 1).alias("key"),
        F.lit("string").alias("kind"),
        F.substr(new, F.instr(new, mark) + 1).alias("value"),
    ))


def _named(entries: Column) -> Column:
    """Canonical field names and values; entries without a name are dropped."""
    named = F.transform(entries, lambda n: F.struct(
        norm_field_name(n["key"]).alias("field"), n["kind"].alias("kind"),
        norm_value(n["value"], n["kind"]).alias("value")))
    return F.filter(named, lambda n: n["field"] != "").cast(ENTRIES)


def _first_per_field(entries: Column) -> Column:
    """First entry of every field, in reply order.

    A sort inside the row: equal names become neighbours and each name's first occurrence
    is kept.  No shuffle, and a reply with very many keys stays ``n log n``.
    """
    by_name = F.sort_array(F.transform(entries, lambda n, i: F.struct(
        n["field"].alias("field"), i.alias("pos"), n["kind"].alias("kind"), n["value"].alias("value"))))
    firsts = let(by_name, lambda names: F.filter(names, lambda n, i: (i == 0) | (
        F.get(names, i - 1)["field"] != n["field"])))
    return F.sort_array(F.transform(firsts, lambda n: F.struct(
        n["pos"].alias("pos"), n["field"].alias("field"), n["kind"].alias("kind"), n["value"].alias("value"))))


def with_entries(parsed: DataFrame, reply: str = "response", when: Column | None = None) -> DataFrame:
    """Adds ``_entries``: first entry per field in reply order (JSON first, else lines).

    The JSON kernel has named and normalised its entries; lines are named here.
    """
    wanted = F.lit(True) if when is None else when
    named = F.col("_tree.entries")
    found = F.when(F.size(named) > 0, named).otherwise(_first_per_field(_named(_line_entries(F.col(reply)))))
    return parsed.withColumn("_entries", F.when(wanted, found))


def _field_map(entries: Column) -> Column:
    pairs = F.transform(entries, lambda n: F.struct(n["field"], n["value"]))
    return F.map_from_entries(pairs).cast("map<string,string>")


def _dense_fields(schema: Column, entries: Column) -> Column:
    """Every schema field in schema order, NULL where the reply had none."""
    return let(entries, lambda known: F.map_from_entries(F.transform(schema, lambda f: F.struct(
        f.alias("key"), F.get(F.filter(known, lambda n: n["field"] == f), F.lit(0))["value"].alias("value")))))


def _additional(schema: Column, entries: Column) -> Column:
    return let(schema, lambda fields: F.filter(entries, lambda n: ~F.array_contains(fields, n["field"])))


# ---- table -------------------------------------------------------------------------------

def _norm_row(cells: Column) -> Column:
    return F.transform(cells, lambda c: norm_value(c["value"], c["kind"]))


def _with_table(parsed: DataFrame, reply: str, wanted: Column) -> DataFrame:
    """Adds ``_table``; JSON with rows (or a list of objects) wins over pipe lines."""
    rows, declared = node(_nodes(), "rows"), node(_nodes(), "columns")
    row = lambda n: F.struct(n["kind"].alias("kind"), leaves(n["items"]).alias("cells"))
    has_rows = _is_object() & rows.isNotNull()
    is_list = (F.col("_tree.kind") == "array") & (F.get(_nodes(), F.lit(0))["kind"] == "object")
    raw = (
        F.when(has_rows, F.when(rows["kind"] == "array", F.transform(rows["items"], row)).otherwise(
            F.transform(F.slice(_nodes(), 1, 0), row)))
        .when(is_list, F.transform(_nodes(), row))
    )
    own_names = F.when(declared["kind"] == "array", F.transform(
        declared["items"], lambda c: F.coalesce(c["value"], F.lit("None"))
    )).when(declared["kind"] == "object", F.transform(declared["items"], lambda c: c["key"]))
    first_object = F.get(F.filter("_raw", lambda r: (r["kind"] == "object") & (F.size(r["cells"]) > 0)), F.lit(0))
    columns = (
        F.when(is_list, F.transform(F.get(_nodes(), F.lit(0))["items"], lambda c: c["key"]))
        .when(has_rows, own_names)
    )
    by_name = lambda cells: F.map_from_entries(F.transform(cells, lambda c: F.struct(c["key"], norm_value(c["value"], c["kind"]))))
    values_of = lambda names: F.transform(
        F.filter("_raw", lambda r: r["kind"].isin(*_CONTAINERS)),
        lambda r: F.when(r["kind"] == "array", _norm_row(r["cells"])).otherwise(
            let(by_name(r["cells"]), lambda values: F.transform(names, lambda name: F.try_element_at(values, name)))),
    )
    json_rows = let(F.col("_columns"), values_of)
    split_line = lambda line: F.transform(
        F.split(F.btrim(strip(line), F.lit("|")), r"\|", -1), strip)
    piped = F.filter(
        F.transform(F.filter(lines(F.col(reply)), lambda ln: F.length(F.translate(ln, "|", "")) <= F.length(ln) - 2), split_line),
        lambda cells: ~F.forall(cells, lambda c: c.rlike(TABLE_RULE_CELL)),
    )
    pipe_rows = F.transform(
        F.slice("_piped", F.lit(2), F.greatest(F.size("_piped"), F.lit(1))), lambda cells: F.transform(cells, norm_text))
    some_value = lambda cells: F.exists(cells, lambda c: c.isNotNull())
    return (
        parsed
        .withColumn("_raw", F.when(wanted, raw))
        .withColumn("_names", F.when(wanted, columns))
        .withColumn("_columns", F.when(F.size("_names") > 0, F.col("_names")).otherwise(
            F.coalesce(F.transform(first_object["cells"], lambda c: c["key"]), dims.string_array(()))))
        .withColumn("_piped", F.when(wanted & F.col("_raw").isNull(), piped))
        .withColumn("_table", F.when(wanted, F.struct(
            F.when(F.col("_raw").isNotNull(), F.col("_columns")).otherwise(
                F.coalesce(F.get("_piped", F.lit(0)), dims.string_array(()))).alias("columns"),
            F.filter(F.when(F.col("_raw").isNotNull(), json_rows).otherwise(pipe_rows), some_value).alias("rows"),
        )).cast(TABLE_TYPE))
        .drop("_raw", "_names", "_columns", "_piped")
    )


# ---- summary and answer --------------------------------------------------------------------

def _summary(reply: Column) -> Column:
    return norm_text(F.coalesce(_string_member("summary"), F.regexp_replace(reply, FENCE_MARK, "")))


def _answer(reply: Column) -> Column:
    return norm_text(F.coalesce(_string_member("answer"), reply))


# ---- operators -------------------------------------------------------------------------------

def task_dispatch(
    replies: DataFrame,
    reply: str = "response",
    task: str = "task",
    document_type: str = "document_type_hint",
    tasks: tuple[str, ...] = dims.ANALYSIS_TASKS,
    phrases: PhraseTable | None = None,
) -> DataFrame:
    """Parse a mixed corpus: each reply by its own task.

    Adds document_type, fields, additional_fields, table, summary, answer, confidence,
    parse_success and parse_errors; the reply and every other input column are kept.
    Key-value replies with an unknown type hint come back as errors, not exceptions.
    ``tasks`` names the tasks that occur, when fewer than all; others count as unsupported.
    ``phrases`` are the evidence for document types, where the fixed ones are not meant.
    """
    name, raw = F.col(task), F.col("_reply")
    is_a = {t: name == t for t in tasks}
    hint = F.col(document_type) if document_type in replies.columns else F.lit(None).cast("string")
    results = {
        "document_type": F.lit(None).cast("string"),
        "fields": F.lit(None).cast("map<string,string>"),
        "additional_fields": F.lit(None).cast("map<string,string>"),
        "table": F.lit(None).cast(TABLE_TYPE),
        "summary": F.lit(None).cast("string"),
        "answer": F.lit(None).cast("string"),
        "confidence": F.lit(None).cast("double"),
    }
    error = F.when(~F.coalesce(name.isin(*tasks), F.lit(False)), F.concat(
        F.lit("Unsupported task: "), F.coalesce(name, F.lit("NULL"))))
    # table cells and column names may be objects or arrays; no other parser reads their text
    nested = F.coalesce(is_a[dims.TABLE], F.lit(False)) if dims.TABLE in tasks else False
    fields = F.coalesce(is_a[dims.KEY_VALUE], F.lit(False)) if dims.KEY_VALUE in tasks else False
    # a type may be a container with members; summary and answer are texts of the payload itself
    depth = F.when(name == dims.TABLE, 3).when(name == dims.CLASSIFICATION, 2).otherwise(1)
    staged = with_payload(replies.withColumn("_reply", F.coalesce(F.col(reply), F.lit(""))), "_reply", nested, fields, depth)

    if dims.CLASSIFICATION in tasks:
        this = is_a[dims.CLASSIFICATION]
        staged = staged.withColumn("_evidence", F.when(this, _evidence(raw))).withColumn(
            "_type", phrases.earliest(F.col("_evidence"))["type"] if phrases else _earliest_type("_evidence"))
        error = error.when(this & is_blank(raw), dims.EMPTY_REPLY).when(this & F.col("_type").isNull(), dims.NO_DOCUMENT_TYPE)
        results["document_type"] = F.when(this, F.coalesce("_type", F.lit(dims.UNKNOWN_TYPE)))
    if dims.KEY_VALUE in tasks:
        this, schema, entries = is_a[dims.KEY_VALUE], F.col("_schema"), F.col("_entries")
        staged = with_entries(staged.withColumn("_schema", F.when(this, dims.schema_fields(hint))), "_reply", when=this)
        unknown = this & hint.isNotNull() & schema.isNull()
        error = error.when(unknown, F.concat(F.lit("Unsupported document type: "), hint)).when(
            this & (F.size(entries) == 0), dims.NO_KEY_VALUES)
        results["document_type"] = F.coalesce(results["document_type"], F.when(this, hint))
        results["fields"] = F.when(F.size(schema) > 0, _dense_fields(schema, entries)).when(
            this & ~unknown, _field_map(entries))
        results["additional_fields"] = F.when(F.size(schema) > 0, _field_map(_additional(schema, entries)))
    if dims.TABLE in tasks:
        this = is_a[dims.TABLE]
        staged = _with_table(staged, "_reply", this)
        error = error.when(this & (F.size("_table.rows") == 0), dims.NO_TABLE_ROWS)
        results["table"] = F.col("_table")
    if dims.SUMMARY in tasks:
        this = is_a[dims.SUMMARY]
        staged = staged.withColumn("_summary", F.when(this, _summary(raw)))
        error = error.when(this & F.col("_summary").isNull(), dims.NO_SUMMARY)
        results["summary"] = F.col("_summary")
    if dims.QA in tasks:
        this = is_a[dims.QA]
        staged = staged.withColumn("_answer", F.when(this, _answer(raw)))
        error = error.when(this & F.col("_answer").isNull(), dims.NO_ANSWER)
        results["answer"] = F.col("_answer")

    results["parse_success"] = F.col("_error").isNull()
    results["parse_errors"] = F.when(F.col("_error").isNull(), dims.string_array(())).otherwise(F.array("_error"))
    kept = [c for c in replies.columns if c not in results]
    return staged.withColumn("_error", error).select(*kept, *[column.alias(c) for c, column in results.items()])


def _single(
    replies: DataFrame, reply: str, task: str, *wanted: str, document_type: str = "document_type_hint", phrases: PhraseTable | None = None,
) -> DataFrame:
    parsed = task_dispatch(replies.withColumn("_task", F.lit(task)), reply, "_task", document_type, (task,), phrases)
    kept = [c for c in replies.columns if c not in wanted]
    return parsed.select(*kept, *wanted, "parse_success", "parse_errors")


def classify_reply(replies: DataFrame, reply: str = "response", phrases: PhraseTable | None = None) -> DataFrame:
    """Adds document_type, parse_success, parse_errors; ``phrases`` (lower case) in place of the fixed ones."""
    return _single(replies, reply, dims.CLASSIFICATION, "document_type", phrases=phrases)


def summary_parse(replies: DataFrame, reply: str = "response") -> DataFrame:
    return _single(replies, reply, dims.SUMMARY, "summary")


def qa_parse(replies: DataFrame, reply: str = "response") -> DataFrame:
    return _single(replies, reply, dims.QA, "answer")


def table_parse(replies: DataFrame, reply: str = "response") -> DataFrame:
    """Adds ``table``: ``struct<columns, rows>``, rows without any value dropped."""
    return _single(replies, reply, dims.TABLE, "table")


def parse_key_value(replies: DataFrame, reply: str = "response", document_type: str = "document_type_hint") -> DataFrame:
    """Adds fields (dense over the hinted type's schema) and additional_fields."""
    return _single(replies, reply, dims.KEY_VALUE, "fields", "additional_fields", document_type=document_type)


def kv_long(replies: DataFrame, reply: str = "response") -> DataFrame:
    """One row per extracted field: pos, field, value, value_kind (first entry wins)."""
    keep = [c for c in replies.columns if c != reply]
    rows = explode_rows(with_entries(with_payload(replies, reply, named=True), reply), F.col("_entries"), "_at", "_e")
    return rows.select(*keep, "_e.pos", "_e.field", "_e.value", F.col("_e.kind").alias("value_kind"))


def kv_dense(replies: DataFrame, reply: str = "response", document_type: str = "document_type_hint") -> DataFrame:
    """One row per (reply, schema field of the hinted type), in schema order."""
    keep = [c for c in replies.columns if c != reply]
    parsed = parse_key_value(replies, reply, document_type)
    return explode_rows(parsed, F.col("fields"), "ordinal", "field", "value").select(*keep, "ordinal", "field", "value")


def kv_additional(replies: DataFrame, reply: str = "response", document_type: str = "document_type_hint") -> DataFrame:
    """One row per extracted field outside the hinted type's schema."""
    keep = [c for c in replies.columns if c != reply]
    parsed = parse_key_value(replies, reply, document_type)
    return explode_rows(parsed, F.col("additional_fields"), "_at", "field", "value").select(*keep, "field", "value")


def kv_wide(replies: DataFrame, document_type: str, reply: str = "response", hint: str = "document_type_hint") -> DataFrame:
    """One typed table of a document type: a row per reply of that type, a column per field of its schema.

    The schema names the columns, so this pivot is a projection of the parsed row: no pass to find
    the names, no grouping, no exchange.  Input columns but the reply are kept; a field that one of
    them has as its name is called ``<document_type>_<field>``.
    """
    names = dims.DOCUMENT_SCHEMAS[document_type]
    keep = [c for c in replies.columns if c != reply]
    own = replies.filter(F.lower(F.trim(F.col(hint))) == document_type)
    parsed = parse_key_value(own.select(F.struct(*keep).alias("_kept"), reply, hint), reply, hint)
    column = lambda name: F.try_element_at("fields", F.lit(name)).alias(f"{document_type}_{name}" if name in keep else name)
    return parsed.select("_kept.*", *map(column, names))


def cells_long(replies: DataFrame, reply: str = "response") -> DataFrame:
    """One row per table cell: row_idx, col_idx, column_name, value."""
    keep = [c for c in replies.columns if c != reply]
    parsed = table_parse(replies, reply).withColumn("_columns", F.col("table.columns"))
    rows = explode_rows(parsed, F.col("table.rows"), "row_idx", "_row").select(*keep, "_columns", "row_idx", "_row")
    cells = explode_rows(rows, F.col("_row"), "col_idx", "value")
    return cells.select(*keep, "row_idx", "col_idx", F.get("_columns", F.col("col_idx")).alias("column_name"), "value")
