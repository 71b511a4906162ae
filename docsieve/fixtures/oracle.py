"""SQL twins of the catalog queries (DuckDB dialect).

Expected results come from the source rows and the reply shape alone; no reply text is
parsed here, so a parsing mistake cannot cancel itself out.
"""

from __future__ import annotations

from docsieve.fixtures.render import COMPANY, EVENT_BLOCK, EXTENSIONS, HEADS, LABELS, LEDGER_BLOCK, OTHERS, PHRASES, PREFIXES, TOKENS
from docsieve.functions import dims
from docsieve.functions.text import WHITESPACE
from docsieve.operators import prompts

ORACLE: dict[str, str] = {}


def lit(text: str | None) -> str:
    if text is None:
        return "NULL"
    plain = "".join(c if c.isprintable() or c == " " else f"'||chr({ord(c)})||'" for c in text.replace("'", "''"))
    return f"('{plain}')"


def lits(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def case(subject: str, mapping: dict[str, str], default: str = "NULL") -> str:
    return "CASE " + subject + " " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in mapping.items()) + f" ELSE {default} END"


WS = lit(WHITESPACE)
PUNCTUATED = lit(WHITESPACE + ",.;")
money = lambda x: f"CAST({x} AS DECIMAL(18,2))"
text = lambda x: f"CAST({x} AS VARCHAR)"
day = lambda x: f"strftime({x}, '%Y-%m-%d')"
round4 = lambda c, t: f"CASE WHEN {t} > 0 THEN CAST(printf('%.4f', CAST({c} AS DOUBLE) / {t}) AS DOUBLE) END"
comparable = lambda x: f"nullif(trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_./-]+', ' ', 'g'), './- '), '')"
same = lambda a, b: f"({comparable(a)} IS NOT DISTINCT FROM {comparable(b)})"


def normed(x: str) -> str:
    bare = f"rtrim(trim(trim(trim({x}, {WS}), '\"'''), {WS}), {PUNCTUATED})"
    return f"CASE WHEN lower({bare}) IN ({', '.join(lit(t) for t in dims.NULL_TOKENS)}) OR regexp_matches({bare}, '^<[^<>]*>$') THEN NULL ELSE {bare} END"


# ---- source rows ------------------------------------------------------------------------------

_NAMES = {t: lits(dims.DOCUMENT_SCHEMAS[t]) for t in LABELS}
_INVOICES = f"""
li AS (SELECT l_orderkey, count(*) AS n, min(CAST(l_linenumber AS BIGINT) * 1000000000000000 + l_partkey) % 1000000000000000 AS partkey
       FROM lineitem GROUP BY 1),
invoices AS (
  SELECT 'ORD-' || o_orderkey AS document_id, 'invoice' AS document_type, o_orderkey AS k,
         ['INV-' || o_orderkey, c_name, {day('o_orderdate')}, p_name, {text('coalesce(n, 0)')}, {text(money('o_totalprice'))}] AS vals
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN li ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = partkey)"""
_STATEMENT_ROWS = f"""
ev AS (
  SELECT user_id, event_id // {EVENT_BLOCK} AS block, event_id, ts, event_type,
         CASE WHEN event_id % 2 = 1 THEN {money('value')} END AS debit, CASE WHEN event_id % 2 = 0 THEN {money('value')} END AS credit,
         CASE WHEN event_id % 2 = 1 THEN -{money('value')} ELSE {money('value')} END AS signed,
         row_number() OVER w AS rn,
         sum(CASE WHEN event_id % 2 = 1 THEN -{money('value')} ELSE {money('value')} END) OVER (w ROWS UNBOUNDED PRECEDING) AS balance
  FROM events WINDOW w AS (PARTITION BY user_id, event_id // {EVENT_BLOCK} ORDER BY ts, event_id))"""
_DOCS = f"""{_INVOICES},{_STATEMENT_ROWS},
docs AS (
  SELECT * FROM invoices
  UNION ALL
  SELECT 'USR-' || user_id || '-' || block, 'bank_statement', user_id + block,
         ['User ' || user_id, {day('min(ts)')} || ' to ' || {day('max(ts)')}, {day('min(ts)')},
          max(event_type) FILTER (rn = 1), {text('max(debit) FILTER (rn = 1)')}, {text('max(credit) FILTER (rn = 1)')}, {text(money('sum(signed)'))}]
  FROM ev GROUP BY user_id, block
  UNION ALL
  SELECT 'EMP-' || c_custkey, 'salary_slip', c_custkey,
         [c_name, 'EMP-' || c_custkey, '2024-' || lpad({text('c_custkey % 12 + 1')}, 2, '0'), {text(money('c_acctbal'))},
          {text('(c_custkey % 7) * 100')}, {text('(c_custkey % 5) * 50')},
          {text(money(money('c_acctbal') + ' + (c_custkey % 7) * 100 - (c_custkey % 5) * 50'))}]
  FROM customer
  UNION ALL
  SELECT 'ID-' || s_suppkey, 'identity_document', s_suppkey,
         [CASE WHEN s_suppkey % 2 = 0 THEN 'passport' ELSE 'identity card' END, s_name, 'ID-' || s_suppkey,
          {day("DATE '1960-01-01' + CAST(s_suppkey % 10000 AS INTEGER)")}, {day("DATE '2030-01-01' + CAST(s_suppkey % 3650 AS INTEGER)")}]
  FROM supplier)"""


def _long(source: str) -> str:
    """One row per document field: i, n, field, value and the value as read."""
    return f"""
src AS (
  SELECT *, CASE WHEN k % 7 = 3 AND i = n - 1 THEN coalesce(value, '') || '9' ELSE value END AS rv, k % 10 AS v
  FROM (SELECT document_id, document_type, k, len(vals) AS n, unnest(range(len(vals))) AS i,
               unnest({case('document_type', _NAMES)}) AS field, unnest(vals) AS value FROM {source}))"""


_ALL = f"WITH {_DOCS},{_long('docs')}"

# What the key-value parser gets out of each reply shape.
_FULL = "(v IN (0, 1, 5, 7, 9) OR k % 20 = 14 OR (v = 2 AND document_type <> 'invoice'))"
_FLAT = "(v = 2 AND document_type = 'invoice' AND field NOT IN ('item', 'quantity'))"
_KV = f"""
kv AS (
  SELECT document_id, document_type, k, i, field, CASE WHEN v = 8 AND i % 2 = 1 THEN NULL ELSE nullif(rv, '') END AS value
  FROM src WHERE {_FULL} OR {_FLAT} OR v = 8),
extra AS (
  SELECT document_id, document_type, 'remark' AS field, 'checked' AS value FROM docs WHERE k % 10 = 5
  UNION ALL SELECT document_id, document_type, 'document_type', 'invoice' FROM docs WHERE k % 10 = 2 AND document_type = 'invoice'
  UNION ALL SELECT document_id, document_type, 'company', '{COMPANY}' FROM docs WHERE k % 10 = 2 AND document_type = 'invoice')"""

ORACLE["kv_long"] = f"{_ALL},{_KV} SELECT document_id, field, value FROM kv UNION ALL SELECT document_id, field, value FROM extra"
_DENSE = f"{_ALL},{_KV}, dense AS (SELECT s.document_id, s.document_type, s.k, s.i, s.field, s.value AS expected, kv.value AS value FROM src s LEFT JOIN kv USING (document_id, field))"
ORACLE["kv_dense"] = f"{_DENSE} SELECT document_id, CAST(i AS INTEGER) AS ordinal, field, value FROM dense"
_WIDE = lambda t: f"""{_DENSE} SELECT document_id, {', '.join(f"max(value) FILTER (field = '{f}') AS {f}" for f in dims.DOCUMENT_SCHEMAS[t])}
FROM dense WHERE document_type = '{t}' GROUP BY document_id"""
ORACLE["kv_wide"], ORACLE["kv_wide_statements"] = _WIDE("invoice"), _WIDE("bank_statement")
ORACLE["kv_additional"] = f"{_ALL},{_KV} SELECT document_id, field, value FROM extra"
_FIELD_DOC = f"""{_DENSE}, scored AS (
  SELECT document_id, document_type, CAST(count(*) AS INTEGER) AS total_fields,
         CAST(count(*) FILTER ({same('value', 'expected')}) AS INTEGER) AS correct_fields,
         string_agg(field || CASE WHEN {same('value', 'expected')} THEN '=1' ELSE '=0' END, ',' ORDER BY i) AS per_field
  FROM dense GROUP BY 1, 2)"""
ORACLE["field_accuracy_doc"] = f"{_FIELD_DOC} SELECT *, {round4('correct_fields', 'total_fields')} AS accuracy FROM scored"
ORACLE["field_accuracy_by_type"] = f"""{_FIELD_DOC}
SELECT document_type, count(*) AS documents, CAST(sum(total_fields) AS BIGINT) AS total_fields, CAST(sum(correct_fields) AS BIGINT) AS correct_fields,
       {round4('sum(correct_fields)', 'sum(total_fields)')} AS accuracy
FROM scored GROUP BY ROLLUP (document_type)"""

# ---- classification ---------------------------------------------------------------------------------

_OTHER_TYPE = {t: lit(next(x for x, p in PHRASES.items() if p == o or (o == "invoice" and x == "invoice") or (o == "bank statement" and x == "bank_statement")))
               for t, o in OTHERS.items()}
_TYPED = f"""typed AS (
  SELECT document_id, document_type AS expected, k,
         CASE WHEN k % 6 IN (0, 1, 2) THEN document_type WHEN k % 6 = 4 THEN {case('document_type', _OTHER_TYPE)} ELSE 'unknown' END AS document_type
  FROM docs)"""
ORACLE["classify_reply"] = f"""WITH {_DOCS}, {_TYPED}
SELECT document_id, document_type, document_type <> 'unknown' AS parse_success,
       CASE WHEN k % 6 = 5 THEN {lit(dims.EMPTY_REPLY)} WHEN k % 6 = 3 THEN {lit(dims.NO_DOCUMENT_TYPE)} END AS parse_error
FROM typed"""
ORACLE["classify_reply_table"] = ORACLE["classify_reply"]
ORACLE["classification_accuracy"] = f"""WITH {_DOCS}, {_TYPED}
SELECT expected, count(*) AS total, count(*) FILTER (document_type = expected) AS correct,
       {round4('count(*) FILTER (document_type = expected)', 'count(*)')} AS accuracy
FROM typed GROUP BY 1"""

# ---- candidates and structured objects -------------------------------------------------------------

_HAS_JSON = "(k % 10 IN (0, 1, 2, 3, 7, 8, 9) OR k % 20 = 14)"
_TEXT = lambda x: f"coalesce(CAST(to_json({x}) AS VARCHAR), 'null')"
_PAIRS = lambda name, value: f"'{{' || string_agg(CAST(to_json({name}) AS VARCHAR) || ':' || {_TEXT(value)}, ',' ORDER BY i) || '}}'"
_NULLED = f"CASE WHEN i % 2 = 1 THEN {lits(TOKENS)}[CAST((i + k) % {len(TOKENS)} AS INTEGER) + 1] ELSE rv END"
_LABEL = case('document_type', {t: f"{lits(labels)}[i + 1]" for t, labels in LABELS.items()})
_SHAPES = f"""
texts AS (
  SELECT document_id, document_type, k, {_PAIRS('field', 'rv')} AS fields, {_PAIRS('field', _NULLED)} AS nulled, {_PAIRS(_LABEL, 'rv')} AS labelled,
         '[' || string_agg('{{' || CAST(to_json(field) AS VARCHAR) || ':' || {_TEXT('rv')} || '}}', ',' ORDER BY i) || ']' AS listed,
         list({_TEXT('rv')} ORDER BY i) AS vs, min(field) FILTER (i = 0) AS f0 FROM src GROUP BY 1, 2, 3),
expected AS (
  SELECT document_id, k, '{{"document_type":"' || document_type || '","fields":' || CASE k % 10 WHEN 7 THEN listed WHEN 8 THEN nulled
           WHEN 9 THEN '{{"' || f0 || '":"stale",' || substr(fields, 2) ELSE fields END || ',"tables":[],"summary":"'
           || CASE WHEN k % 10 = 9 THEN 'uses }} and {{ inside' ELSE 'Plain record' END || '"}}' AS object,
         fields, labelled, document_type, '{{"document_type":"invoice","invoice_number":' || vs[1] || ',"date":' || vs[3] || ',"customer_name":' || vs[2]
           || ',"company":"{COMPANY}","total_amount":' || vs[6] || '}}' AS flat
  FROM texts),
single AS (
  SELECT document_id, 0 AS pos, CASE WHEN k % 10 = 2 THEN CASE WHEN document_type = 'invoice' THEN flat ELSE labelled END
         WHEN k % 10 = 3 THEN '{{"text":' || object || '}}' WHEN k % 10 = 4 THEN fields ELSE object END AS candidate
  FROM expected WHERE {_HAS_JSON}),
several AS (
  SELECT document_id, unnest(range(3)) AS pos, unnest([
    '{{"id":"' || document_id || '","type":"' || document_type || '"}}', '{{"n":' || k || ',"id":"' || document_id || '"}}', '{{"k":' || k || ',"s":"}} not the end {{"}}']) AS candidate
  FROM docs WHERE k % 3 = 0
  UNION ALL SELECT document_id, 0, '{{"a":{{"k":' || k || ',"s":"}} not the end {{"}}}}' FROM docs WHERE k % 3 = 1)"""
ORACLE["json_candidates"] = f"""{_ALL},{_SHAPES}
SELECT document_id, CAST(pos AS INTEGER) AS pos, candidate FROM single UNION ALL SELECT 'several ' || document_id, CAST(pos AS INTEGER), candidate FROM several"""
ORACLE["json_candidates_sql"] = f"{_ALL},{_SHAPES} SELECT document_id, CAST(pos AS INTEGER) AS pos, candidate FROM several"
ORACLE["json_first_valid"] = f"""WITH {_DOCS}
SELECT document_id, CASE WHEN {_HAS_JSON} THEN 0 END::INTEGER AS candidate_pos, CASE WHEN {_HAS_JSON} THEN 'object' END AS payload_kind,
       CASE WHEN NOT {_HAS_JSON} THEN {lit(dims.NO_JSON_OBJECT)} END AS json_error
FROM docs"""
_ENVELOPE = lits(("document_type", "fields", "tables", "summary"))
_ENVELOPE_KINDS = "['string', {kind}, 'array', 'string']"
ORACLE["json_entries"] = f"""{_ALL}
SELECT document_id, CAST(pos AS INTEGER) AS pos, key, kind FROM (
  SELECT document_id, unnest(range(4)) AS pos, unnest({_ENVELOPE}) AS key,
         unnest(['string', CASE WHEN k % 10 = 7 THEN 'array' ELSE 'object' END, 'array', 'string']) AS kind
  FROM docs WHERE k % 10 IN (0, 1, 7, 8, 9)
  UNION ALL SELECT document_id, 0, 'text', 'object' FROM docs WHERE k % 10 = 3
  UNION ALL SELECT document_id, i, field, CASE WHEN rv IS NULL THEN 'null' ELSE 'string' END FROM src WHERE k % 20 = 14
  UNION ALL SELECT document_id, i, {case('document_type', {t: f"{lits(labels)}[i + 1]" for t, labels in LABELS.items()})},
                   CASE WHEN rv IS NULL THEN 'null' ELSE 'string' END
            FROM src WHERE v = 2 AND document_type <> 'invoice'
  UNION ALL SELECT document_id, unnest(range(6)), unnest({lits(('document_type', *('invoice_number', 'date', 'customer_name', 'company', 'total_amount')))}), 'string'
            FROM docs WHERE k % 10 = 2 AND document_type = 'invoice')"""

# Fields of the structured object per shape; order as found.
_OBJECT_FIELDS = f"""
objf AS (
  SELECT document_id, k, i AS pos, field, CASE WHEN v = 8 AND i % 2 = 1 THEN {lits(TOKENS)}[CAST((i + k) % {len(TOKENS)} AS INTEGER) + 1] ELSE rv END AS value
  FROM src WHERE v IN (0, 1, 3, 8, 9)
  UNION ALL SELECT document_id, k, CASE field WHEN 'date' THEN 1 ELSE 0 END, field, rv FROM src WHERE k % 20 = 14 AND field IN ('invoice_number', 'date')
  UNION ALL SELECT document_id, k, CASE field WHEN 'invoice_number' THEN 0 WHEN 'date' THEN 1 WHEN 'customer' THEN 2 ELSE 4 END,
                   CASE field WHEN 'customer' THEN 'customer_name' WHEN 'amount' THEN 'total_amount' ELSE field END, rv
            FROM src WHERE v = 2 AND document_type = 'invoice' AND field IN ('invoice_number', 'date', 'customer', 'amount')
  UNION ALL SELECT document_id, k, 3, 'company', '{COMPANY}' FROM invoices WHERE k % 10 = 2)"""
ORACLE["fields_long"] = f"""{_ALL},{_OBJECT_FIELDS}
SELECT document_id, CAST(pos AS INTEGER) AS pos, field, value, CASE WHEN value IS NULL THEN 'null' ELSE 'string' END AS value_kind FROM objf"""
_errors = lambda *messages: lits(messages)
_moved = [dims.UNEXPECTED_FIELD + f for f in dims.FLAT_FIELD_NAMES]
_missing = {f: dims.MISSING_FIELD + f for f in dims.REQUIRED_KEYS}
_extra = lambda names, *present: _errors(*[_missing[f] for f in dims.REQUIRED_KEYS if f not in present], *[dims.UNEXPECTED_FIELD + n for n in sorted(names) if n not in present])
_OPEN = {t: _extra(dims.DOCUMENT_SCHEMAS[t], *[f for f in dims.REQUIRED_KEYS if f in dims.DOCUMENT_SCHEMAS[t]]) for t in LABELS if t != 'invoice'}
_SCHEMA_ERRORS = f"""CASE
  WHEN k % 10 = 2 AND document_type <> 'invoice' THEN {case('document_type', {t: _extra(LABELS[t]) for t in LABELS if t != 'invoice'})}
  WHEN k % 20 = 14 AND document_type <> 'invoice' THEN {case('document_type', _OPEN)}
  WHEN k % 10 = 2 THEN {_errors(*_moved, _missing['tables'], _missing['summary'])}
  WHEN k % 10 = 3 THEN {_errors(dims.UNWRAPPED_TEXT)}
  WHEN k % 20 = 14 THEN {_errors(_moved[0], _moved[1], _missing['document_type'], _missing['tables'], _missing['summary'],
                                 *[dims.UNEXPECTED_FIELD + f for f in ('amount', 'customer', 'item', 'quantity')])}
  WHEN k % 10 = 7 THEN {_errors(dims.TYPE_ERRORS['fields'])}
  ELSE [] END"""
_OBJECTS = f"""{_ALL},{_OBJECT_FIELDS},
obj AS (
  SELECT document_id, k, k % 10 AS variant, {_HAS_JSON} AS parse_success, k % 10 IN (0, 1, 3, 8, 9) AS schema_valid,
         (k % 10 = 2 OR k % 20 = 14) AND document_type = 'invoice' AS schema_normalized, {_SCHEMA_ERRORS} AS errs, document_type AS family,
         CASE WHEN k % 10 IN (0, 1, 3, 7, 8, 9) OR (k % 10 = 2 AND document_type = 'invoice') THEN document_type
              WHEN k % 20 = 14 AND document_type = 'identity_document' THEN vals[1] END AS document_type,
         CASE WHEN k % 10 IN (0, 1, 3, 7, 8) THEN 'Plain record' WHEN k % 10 = 9 THEN 'uses }} and {{ inside' END AS summary
  FROM docs),
counted AS (SELECT obj.*, CAST(coalesce(n, 0) AS INTEGER) AS field_count FROM obj LEFT JOIN (
  SELECT document_id, count(*) FILTER (value IS NOT NULL AND value <> '') AS n FROM objf GROUP BY 1) USING (document_id))"""
_pick = lambda field: f"(SELECT max(value) FROM objf WHERE objf.document_id = counted.document_id AND field = '{field}')"
ORACLE["structured_parse"] = f"""{_OBJECTS}
SELECT document_id, document_type, summary, parse_success, schema_valid, schema_normalized, field_count,
       CAST(len(errs) AS INTEGER) AS n_schema_errors, CASE WHEN NOT parse_success THEN {lit(dims.NO_JSON_OBJECT)} END AS parse_error,
       invoice_number, invoice_date, amount
FROM counted LEFT JOIN (
  SELECT document_id, max(value) FILTER (field = 'invoice_number') AS invoice_number,
         max(value) FILTER (field = 'date') AS invoice_date, max(value) FILTER (field = 'amount') AS amount
  FROM objf GROUP BY 1) USING (document_id)"""
ORACLE["schema_errors"] = f"{_OBJECTS} SELECT document_id, CAST(pos AS INTEGER) AS pos, error FROM (SELECT document_id, unnest(range(len(errs))) AS pos, unnest(errs) AS error FROM obj)"
ORACLE["schema_error_counts"] = f"{_OBJECTS} SELECT variant, error, count(*) AS replies FROM (SELECT variant, unnest(errs) AS error FROM obj) GROUP BY 1, 2"
ORACLE["schema_rates"] = f"""{_OBJECTS}
SELECT variant, count(*) AS replies, count(*) FILTER (parse_success) AS parsed, count(*) FILTER (schema_valid) AS compliant,
       count(*) FILTER (schema_normalized) AS normalized, CAST(sum(field_count) AS BIGINT) AS fields_extracted
FROM counted GROUP BY 1"""
_STRICT = f"""{_OBJECTS},
hits AS (
  SELECT s.document_id, count(*) AS n, count(*) FILTER (
    trim(CASE WHEN o.field IS NULL THEN '' ELSE coalesce(o.value, 'None') END, {WS}) = trim(coalesce(s.value, 'None'), {WS})) AS hit
  FROM src s LEFT JOIN objf o ON o.document_id = s.document_id AND o.field = s.field GROUP BY 1),
strict AS (
  SELECT document_id AS sample_id, 'echo' AS model, 'v' || variant AS dataset, 'document_understanding' AS task, metric, score FROM (
    SELECT document_id, variant, unnest(['field_extraction_accuracy', 'document_classification_accuracy', 'ocr_correction_accuracy', 'json_parse_success',
                  'schema_compliance', 'schema_normalization_rate', 'field_extraction_count']) AS metric,
           unnest([CAST(hit AS DOUBLE) / n, CASE WHEN document_type = family THEN 1.0::DOUBLE ELSE 0.0 END,
                   CASE WHEN k % 2 = 0 THEN CASE WHEN summary = 'Plain record' THEN 1.0::DOUBLE ELSE 0.0 END END,
                   CAST(CAST(parse_success AS INTEGER) AS DOUBLE), CAST(CAST(schema_valid AS INTEGER) AS DOUBLE), CAST(CAST(schema_normalized AS INTEGER) AS DOUBLE),
                   CASE WHEN parse_success THEN CAST(field_count AS DOUBLE) END]) AS score
    FROM counted JOIN hits USING (document_id)) WHERE score IS NOT NULL)"""
ORACLE["strict_metrics"] = f"{_STRICT} SELECT model, dataset, task, sample_id, metric, round(score, 6) AS score FROM strict"
ORACLE["bench_summary"] = f"{_STRICT} SELECT model, dataset, task, metric, count(*) AS samples, round(avg(score), 6) AS mean_score FROM strict GROUP BY 1, 2, 3, 4"
_CUBED = [("model", 8), ("dataset", 4), ("task", 2), ("metric", 1)]
ORACLE["bench_cube"] = f"""{_STRICT},
c AS (SELECT CAST(grouping_id(model, dataset, task, metric) AS INTEGER) AS level, model, dataset, task, metric, count(*) AS samples, round(avg(score), 6) AS mean_score
      FROM strict GROUP BY CUBE (model, dataset, task, metric)),
l AS (SELECT level, {', '.join(f"CASE WHEN (level & {bit}) = 0 THEN {name} END AS {name}" for name, bit in _CUBED)}, score, sample_id
      FROM strict CROSS JOIN (SELECT unnest(range(16)) AS level)),
r AS (SELECT *, row_number() OVER (PARTITION BY level, model, dataset, task, metric ORDER BY score, sample_id) AS n FROM l),
s AS (SELECT level, model, dataset, task, metric, string_agg(sample_id || '=' || printf('%.4f', score), ',' ORDER BY n) AS lowest FROM r WHERE n <= 3 GROUP BY ALL)
SELECT c.*, s.lowest FROM c JOIN s ON s.level = c.level AND {' AND '.join(f"s.{name} IS NOT DISTINCT FROM c.{name}" for name, _ in _CUBED)}"""
ORACLE["inference_log"] = """
SELECT CAST(event_id AS VARCHAR) AS document_id, 1 AS page_number, 'echo' AS model_id, event_type AS task,
       CASE WHEN event_id % 20 <> 0 THEN value END AS latency_seconds,
       event_id % 20 <> 0 AS parse_success, event_id % 20 <> 0 AS schema_valid, FALSE AS schema_normalized,
       CASE WHEN event_id % 20 <> 0 THEN 'event' END AS document_type,
       CAST(CASE WHEN event_id % 20 <> 0 THEN 2 ELSE 0 END AS INTEGER) AS number_of_extracted_fields,
       CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS ocr_text_length, '2024-01-01 00:00:00' AS logged_at,
       CAST(CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_parse_errors, 0 AS n_schema_errors
FROM events"""

# ---- tables ---------------------------------------------------------------------------------------------

_LEDGER = f"""
led AS (
  SELECT 'LED-' || (o_orderkey // {LEDGER_BLOCK}) AS document_id, o_orderkey // {LEDGER_BLOCK} AS k, o_orderkey,
         row_number() OVER (PARTITION BY o_orderkey // {LEDGER_BLOCK} ORDER BY o_orderkey) - 1 AS row_idx,
         ['ORD-' || o_orderkey, {day('o_orderdate')}, o_orderstatus, {text(money('o_totalprice'))}] AS vals
  FROM orders),
led_cells AS (
  SELECT document_id, k, row_idx, j AS col_idx, expected,
         CASE WHEN k % 4 = 3 AND j = 2 THEN NULL WHEN j = 3 AND o_orderkey % 7 = 3 THEN expected || '9' ELSE expected END AS value
  FROM (SELECT *, unnest(range(4)) AS j, unnest(vals) AS expected FROM led))"""
_STATEMENT = f"""{_STATEMENT_ROWS},
st_cells AS (
  SELECT document_id, k, row_idx, j AS col_idx, expected, CASE WHEN j = 4 AND event_id % 7 = 3 THEN expected || '9' ELSE expected END AS value
  FROM (SELECT 'USR-' || user_id || '-' || block AS document_id, user_id + block AS k, event_id, rn - 1 AS row_idx, unnest(range(5)) AS j,
               unnest([{day('ts')}, event_type, {text('debit')}, {text('credit')}, {text(money('balance'))}]) AS expected FROM ev))"""
_cell_columns = lambda names: f"document_id, k, CAST(row_idx AS INTEGER) AS row_idx, CAST(col_idx AS INTEGER) AS col_idx, {names} AS column_name, value"
ORACLE["table_cells_json"] = f"""WITH {_LEDGER} SELECT {_cell_columns("CASE WHEN k % 4 = 3 AND col_idx = 2 THEN 'Note' ELSE ['Order', 'Date', 'Status', 'Amount'][col_idx + 1] END")} FROM led_cells"""
ORACLE["table_cells_pipe"] = f"""WITH {_STATEMENT} SELECT {_cell_columns("['Date', 'Description', 'Debit', 'Credit', 'Balance'][col_idx + 1]")} FROM st_cells"""
_TABLE_SCORES = f"""WITH {_LEDGER},{_STATEMENT},
row_scores AS (
  SELECT document_id, row_idx, count(*) AS cells, count(*) FILTER ({same('value', 'expected')}) AS hits
  FROM (SELECT document_id, row_idx, value, expected FROM led_cells UNION ALL SELECT document_id, row_idx, value, expected FROM st_cells) GROUP BY 1, 2),
doc_scores AS (
  SELECT document_id, count(*) AS expected_rows, count(*) AS predicted_rows, count(*) FILTER (hits = cells) AS correct_rows,
         sum(cells) AS total_cells, sum(hits) AS correct_cells FROM row_scores GROUP BY 1)"""
_INTS = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ("expected_rows", "predicted_rows", "correct_rows", "total_cells", "correct_cells"))
ORACLE["table_accuracy"] = f"""{_TABLE_SCORES} SELECT document_id, {_INTS},
  {round4('correct_rows', 'expected_rows')} AS row_accuracy, {round4('correct_cells', 'total_cells')} AS cell_accuracy FROM doc_scores"""
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("expected_rows", "predicted_rows", "correct_rows", "total_cells", "correct_cells"))
ORACLE["table_accuracy_micro"] = f"""{_TABLE_SCORES} SELECT left(document_id, 3) AS family, count(*) AS documents, {_SUMS},
  {round4('sum(correct_rows)', 'sum(expected_rows)')} AS row_accuracy, {round4('sum(correct_cells)', 'sum(total_cells)')} AS cell_accuracy FROM doc_scores GROUP BY 1"""

# ---- summary and answers --------------------------------------------------------------------------------------

ORACLE["summary_parse"] = f"""
SELECT doc_id, summary, summary IS NOT NULL AS parse_success FROM (
  SELECT doc_id, {normed("CASE WHEN doc_id % 3 = 2 THEN text || '...' ELSE text END")} AS summary FROM documents)"""
_ANSWERS = f"""answers AS (
  SELECT document_id, k, {text(money('o_totalprice'))} AS expected,
         CASE WHEN k % 5 <> 2 THEN CASE WHEN k % 7 = 3 THEN {text(money('o_totalprice'))} || '9' ELSE {text(money('o_totalprice'))} END END AS answer
  FROM (SELECT 'ORD-' || o_orderkey AS document_id, o_orderkey AS k, o_totalprice FROM orders))"""
ORACLE["qa_parse"] = f"WITH {_ANSWERS} SELECT document_id, answer, answer IS NOT NULL AS parse_success, CASE WHEN answer IS NULL THEN {lit(dims.NO_ANSWER)} END AS parse_error FROM answers"
ORACLE["qa_exact_match"] = f"""WITH {_ANSWERS}
SELECT k % 5 AS variant, count(*) AS total, count(*) FILTER ({same('answer', 'expected')}) AS correct,
       {round4(f"count(*) FILTER ({same('answer', 'expected')})", 'count(*)')} AS exact_match
FROM answers GROUP BY 1"""
ORACLE["norm_match"] = f"SELECT doc_id, {comparable('text')} AS comparable FROM documents"

# ---- evaluation runs ---------------------------------------------------------------------------------------------

_LAST = "vals[len(vals)]"
_READ = f"CASE WHEN k % 7 = 3 THEN coalesce({_LAST}, '') || '9' ELSE {_LAST} END"
_RUNS = f"""{_DENSE}, {_TYPED},
fields AS (SELECT document_id, count(*) AS total_fields, count(*) FILTER ({same('value', 'expected')}) AS correct_fields FROM dense GROUP BY 1),
kv_any AS (SELECT DISTINCT document_id FROM (SELECT document_id FROM kv UNION ALL SELECT document_id FROM extra)),
runs AS (
  SELECT d.document_id, d.k, task, ord, CASE WHEN (d.k + ord) % 20 = 0 THEN 'FAILED' ELSE 'RUN' END AS status, d.document_type AS expected_document_type,
         (d.k + ord) % 20 <> 0 AS ran, t.document_type AS predicted, d.vals, d.document_type <> 'identity_document' AS tabled,
         CASE WHEN d.k % 5 <> 2 THEN {_READ.replace('vals', 'd.vals').replace('k %', 'd.k %')} END AS answer, f.total_fields, f.correct_fields,
         a.document_id IS NOT NULL AS has_kv, {same(_LAST.replace('vals', 'd.vals'), _READ.replace('vals', 'd.vals').replace('k %', 'd.k %'))} AS last_ok
  FROM docs d JOIN typed t USING (document_id) JOIN fields f USING (document_id) LEFT JOIN kv_any a USING (document_id)
  CROSS JOIN (SELECT unnest(range(5)) AS ord, unnest({lits(dims.ANALYSIS_TASKS)}) AS task)),
scored AS (
  SELECT *,
    CASE WHEN ran AND task = 'classification' THEN predicted = expected_document_type WHEN ran AND task = 'question_answering' THEN {same('answer', _LAST)} END AS label_correct,
    CASE WHEN ran AND task = 'key_value_extraction' THEN total_fields ELSE 0 END AS tf, CASE WHEN ran AND task = 'key_value_extraction' THEN correct_fields ELSE 0 END AS cf,
    CASE WHEN ran AND task = 'table_extraction' AND tabled THEN 1 ELSE 0 END AS er,
    CASE WHEN ran AND task = 'table_extraction' AND tabled AND last_ok THEN 1 ELSE 0 END AS cr,
    CASE WHEN ran AND task = 'table_extraction' AND tabled THEN 3 ELSE 0 END AS tc,
    CASE WHEN ran AND task = 'table_extraction' AND tabled THEN 2 + CAST(last_ok AS INTEGER) ELSE 0 END AS cc,
    CASE WHEN ran THEN ((k * 7 + ord * 13) % 1000) / 1000.0::DOUBLE END AS seconds,
    CASE task WHEN 'classification' THEN predicted <> 'unknown' WHEN 'key_value_extraction' THEN has_kv WHEN 'table_extraction' THEN tabled
              WHEN 'summarization' THEN TRUE ELSE answer IS NOT NULL END AS parsed
  FROM runs)"""
ORACLE["eval_runs"] = f"""{_RUNS}
SELECT document_id, task, status, expected_document_type,
       CASE WHEN ran THEN CASE task WHEN 'classification' THEN predicted WHEN 'key_value_extraction' THEN expected_document_type END END AS document_type,
       CASE WHEN ran THEN parsed END AS parse_success, label_correct, CAST(tf AS INTEGER) AS total_fields, CAST(cf AS INTEGER) AS correct_fields,
       er AS expected_rows, cr AS correct_rows, tc AS total_cells, CAST(cc AS INTEGER) AS correct_cells, {round4('cf', 'tf')} AS field_accuracy
FROM scored"""
_filter = lambda task: f"label_correct IS NOT NULL AND task = '{task}'"
ORACLE["eval_report"] = f"""{_RUNS}
SELECT CASE WHEN count(*) FILTER (ran) > 0 THEN 'RUN' ELSE 'FAILED' END AS status, 'echo' AS model, count(*) FILTER (task = 'classification') AS documents_evaluated, 5 AS tasks,
  count(*) FILTER ({_filter('classification')}) AS class_total, count(*) FILTER ({_filter('classification')} AND label_correct) AS class_correct,
  {round4(f"count(*) FILTER ({_filter('classification')} AND label_correct)", f"count(*) FILTER ({_filter('classification')})")} AS class_accuracy,
  CAST(sum(tf) AS BIGINT) AS kv_total_fields, CAST(sum(cf) AS BIGINT) AS kv_correct_fields, {round4('sum(cf)', 'sum(tf)')} AS kv_accuracy,
  CAST(sum(er) AS BIGINT) AS table_expected_rows, CAST(sum(cr) AS BIGINT) AS table_correct_rows, {round4('sum(cr)', 'sum(er)')} AS table_row_accuracy,
  CAST(sum(tc) AS BIGINT) AS table_total_cells, CAST(sum(cc) AS BIGINT) AS table_correct_cells, {round4('sum(cc)', 'sum(tc)')} AS table_cell_accuracy,
  count(*) FILTER ({_filter('question_answering')}) AS qa_total, count(*) FILTER ({_filter('question_answering')} AND label_correct) AS qa_correct,
  {round4(f"count(*) FILTER ({_filter('question_answering')} AND label_correct)", f"count(*) FILTER ({_filter('question_answering')})")} AS qa_exact_match,
  count(*) FILTER (seconds <> 0) AS time_runs, round(sum(seconds), 3) AS time_total, round(sum(seconds) / count(*) FILTER (seconds <> 0), 3) AS time_mean,
  min(seconds) FILTER (seconds <> 0) AS time_min, max(seconds) AS time_max
FROM scored"""
ORACLE["run_status"] = f"""{_RUNS}
SELECT task, count(*) AS runs, count(*) FILTER (ran) AS executed, count(*) FILTER (NOT ran) AS failed, CASE WHEN bool_or(ran) THEN 'RUN' ELSE 'FAILED' END AS overall_status
FROM scored GROUP BY 1"""
ORACLE["task_dispatch"] = f"""{_RUNS}
SELECT task, status, count(*) AS replies, count(*) FILTER (ran AND parsed) AS parsed, count(*) FILTER (NOT (ran AND parsed)) AS errors,
  count(*) FILTER (task IN ('classification', 'key_value_extraction')) AS typed,
  count(*) FILTER (task = 'summarization' AND ran) AS summaries, count(*) FILTER (task = 'question_answering' AND ran AND answer IS NOT NULL) AS answers,
  CAST(sum(CASE WHEN task = 'table_extraction' AND ran AND tabled THEN 1 ELSE 0 END) AS BIGINT) AS table_rows
FROM scored GROUP BY 1, 2"""
ORACLE["latency_summary"] = """
SELECT event_type, count(*) FILTER (s <> 0) AS timed_runs, round(sum(s), 3) AS total_seconds, round(sum(s) / count(*) FILTER (s <> 0), 3) AS mean_seconds,
       min(s) FILTER (s <> 0) AS min_seconds, max(s) AS max_seconds
FROM (SELECT event_type, CASE WHEN event_id % 20 <> 0 THEN value END AS s FROM events) GROUP BY 1"""

ORACLE["latency_quantiles"] = """
SELECT event_type, count(*) AS timed_runs, TRUE AS p50_close, TRUE AS p90_close, TRUE AS p99_close FROM events WHERE event_id % 20 <> 0 AND value <> 0 GROUP BY 1"""
ORACLE["report_sink"] = f"""{_RUNS},
written AS (
  SELECT 'first' AS run_id, task, CASE WHEN task IN ('classification', 'question_answering') THEN 'again ' || status ELSE status END AS status, label_correct FROM scored
  UNION ALL SELECT 'second', task, status, label_correct FROM scored WHERE status = 'RUN')
SELECT run_id, task, status, count(*) AS runs, count(*) FILTER (label_correct) AS correct FROM written GROUP BY 1, 2, 3"""

# ---- files, words, pages ----------------------------------------------------------------------------------------------

_FILES = f"""
files AS (
  SELECT doc_id, n_chars, CAST(doc_id % 3 + 1 AS INTEGER) AS pdf_pages, 'doc_' || doc_id || {lits(EXTENSIONS)}[CAST(doc_id % {len(EXTENSIONS)} AS INTEGER) + 1] AS filename,
         ['pdf', 'png', 'jpg', 'jpeg', NULL, NULL][CAST(doc_id % 6 AS INTEGER) + 1] AS file_type FROM documents),
man AS (
  SELECT doc_id, sha256('/inbox/' || filename) AS document_id, filename, file_type, n_chars AS file_size_bytes,
         CASE WHEN file_type = 'pdf' THEN pdf_pages WHEN file_type IS NOT NULL THEN 1 END AS page_count, '/inbox/' || filename AS source_path,
         CASE WHEN file_type IS NULL THEN 'QUARANTINED' ELSE 'ACCEPTED' END AS status, CASE WHEN file_type IS NULL THEN 'unsupported_type' END AS reason FROM files)"""
ORACLE["manifest_validate"] = f"WITH {_FILES} SELECT document_id, filename, file_type, file_size_bytes, CASE WHEN file_type IS NULL THEN NULL ELSE page_count END AS page_count, source_path, status, reason FROM man"
ORACLE["manifest_reject_counts"] = f"WITH {_FILES} SELECT reason, count(*) AS files, CAST(sum(file_size_bytes) AS BIGINT) AS bytes FROM man WHERE reason IS NOT NULL GROUP BY 1"
ORACLE["page_explode"] = f"WITH {_FILES} SELECT document_id, source_path, file_type, CAST(unnest(range(1, page_count + 1)) AS INTEGER) AS page_number FROM man WHERE reason IS NULL"
_NAMED = f"""
named AS (
  SELECT doc_id, text, 'batch_' || doc_id % 5 AS folder, {lits(PREFIXES)}[CAST(doc_id % {len(PREFIXES)} AS INTEGER) + 1] || 'doc_' || doc_id || {lits(EXTENSIONS)}[CAST(doc_id % {len(EXTENSIONS)} AS INTEGER) + 1] AS name,
         {lits(EXTENSIONS)}[CAST(doc_id % {len(EXTENSIONS)} AS INTEGER) + 1] AS suffix FROM documents),
headed AS (SELECT *, CASE WHEN doc_id % 7 = 3 THEN {lit(HEADS['.pdf'])} ELSE {case('suffix', {k: lit(v) for k, v in HEADS.items()}, "''")} END AS head FROM named)"""
ORACLE["manifest_scan"] = f"WITH {_NAMED} SELECT folder || '/' || name AS path, CAST(length(head) // 2 + strlen(coalesce(text, '')) AS BIGINT) AS file_size_bytes, TRUE AS dated FROM headed"
ORACLE["signature_check"] = f"""WITH {_NAMED}
SELECT name AS filename, substr(head || CAST(hex(encode(coalesce(text, ''))) AS VARCHAR), 1, 16) AS head,
       CASE WHEN suffix = '' THEN doc_id % 7 = 3 AND FALSE ELSE CASE WHEN doc_id % 7 = 3 THEN suffix = '.pdf' ELSE TRUE END END AS signature_ok
FROM headed WHERE suffix <> '.txt'"""
ORACLE["truth_source"] = f"""{_ALL},
one AS (SELECT document_id, document_type, k, list_sort(list(field || '=' || coalesce(value, '-'))) AS pairs, list(coalesce(value, '-') ORDER BY i) AS vs, list(field ORDER BY i) AS fs,
               max(value) FILTER (i = n - 1) AS answer FROM src GROUP BY 1, 2, 3)
SELECT document_id, document_type, array_to_string(pairs, ',') AS fields, CASE WHEN document_type = 'identity_document' THEN '' ELSE array_to_string(vs[-3:], '|') END AS cells,
       array_to_string(fs[-3:], '|') AS columns, 'What is the ' || fs[-1] || '?' AS question, answer FROM one"""
ORACLE["ocr_text_source"] = """
SELECT doc_id, CASE WHEN doc_id % 4 <> 1 AND doc_id % 9 <> 4 THEN md5(coalesce(text, '')) END AS text_md5,
       CASE WHEN doc_id % 4 <> 1 AND doc_id % 9 = 4 THEN 'side files with one name: 2' END AS ocr_error FROM documents"""
_WORDS = f"""
doc_lines AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
raw_words AS (SELECT doc_id, line, unnest(range(len(ws))) AS word, unnest(ws) AS raw FROM (SELECT doc_id, line, string_split(body, ' ') AS ws FROM doc_lines)),
words AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, line, word, trim(raw, {WS}) AS text, length(raw) * 8 AS width,
         least((doc_id * 31 + line * 13 + word * 7) % 110 - 5, 100) AS conf, line // 5 AS block_num, line // 20 + 1 AS page_number
  FROM raw_words),
kept AS (SELECT * FROM words WHERE text <> '' AND conf >= 0),
line_rows AS (
  SELECT document_id, page_number, block_num, line, string_agg(text, ' ' ORDER BY word) AS text, min(word) * 40 AS x0, line * 20 AS y0,
         max(word * 40 + width) AS x1, line * 20 + 16 AS y1, count(*) AS n, sum(conf) AS conf
  FROM kept GROUP BY 1, 2, 3, 4),
page_rows AS (SELECT document_id, page_number, string_agg(text, chr(10) ORDER BY line) AS text, count(*) AS n_blocks FROM line_rows GROUP BY 1, 2)"""
ORACLE["ocr_word_filter"] = f"WITH {_WORDS} SELECT document_id, count(*) AS words, CAST(sum(length(text)) AS BIGINT) AS chars FROM kept WHERE conf / 100.0 >= 0.5 GROUP BY 1"
ORACLE["ocr_lines"] = f"""WITH {_WORDS}
SELECT document_id, CAST(page_number AS INTEGER) AS page_number, CAST(block_num AS INTEGER) AS block_num, 1 AS par_num, CAST(line % 5 AS INTEGER) AS line_num, 1 AS page_num, text,
       CAST(x0 AS INTEGER) AS x0, CAST(y0 AS INTEGER) AS y0, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1,
       CAST(printf('%.4f', CAST(conf AS DOUBLE) / 100 / n) AS DOUBLE) AS confidence, n AS word_count
FROM line_rows"""
ORACLE["ocr_page_text"] = f"WITH {_WORDS} SELECT document_id, CAST(page_number AS INTEGER) AS page_number, text, CAST(n_blocks AS INTEGER) AS n_blocks FROM page_rows"
ORACLE["ocr_document_text"] = f"WITH {_WORDS} SELECT document_id, string_agg(text, chr(10) ORDER BY page_number) AS ocr_text FROM page_rows GROUP BY 1"
ORACLE["ocr_json"] = f"WITH {_WORDS} SELECT document_id, CAST(count(*) AS INTEGER) AS pages, string_agg(text, chr(12) ORDER BY page_number) AS text FROM page_rows GROUP BY 1"
ORACLE["ocr_clustered"] = ORACLE["ocr_document_text"]
ORACLE["ocr_json_sink"] = f"""WITH {_WORDS} SELECT document_id, CAST(count(*) AS INTEGER) AS pages, CAST(sum(n_blocks) AS INTEGER) AS blocks, 'preprocessed' AS spaces FROM page_rows GROUP BY 1"""
ORACLE["ocr_boxes_original"] = f"""WITH {_WORDS},
own AS (SELECT *, CAST(document_id AS BIGINT) AS d, CASE WHEN CAST(document_id AS BIGINT) % 2 = 0 THEN 2 ELSE 1 END AS f, (CAST(document_id AS BIGINT) + page_number) % 4 AS turn FROM line_rows),
-- corners off the turned page of 2000 by 3000, unscaled, then turned back about its middle
turned AS (SELECT *, x0 * f AS a0, y0 * f AS b0, x1 * f AS a1, y1 * f AS b1 FROM own),
back AS (
  SELECT *, [a0, 2500 - b1, 2000 - a1, b0 - 500][CAST(turn AS INTEGER) + 1] AS l, [b0, a0 + 500, 3000 - b1, 2500 - a1][CAST(turn AS INTEGER) + 1] AS t,
         [a1, 2500 - b0, 2000 - a0, b1 - 500][CAST(turn AS INTEGER) + 1] AS r, [b1, a1 + 500, 3000 - b0, 2500 - a0][CAST(turn AS INTEGER) + 1] AS u
  FROM turned)
SELECT document_id, CAST(page_number AS INTEGER) AS page_number, CAST(block_num AS INTEGER) AS block_num, 1 AS par_num, CAST(line % 5 AS INTEGER) AS line_num, 1 AS page_num,
       {', '.join(f"CAST(CASE WHEN d % 5 <> 0 THEN {c} END AS INTEGER) AS {n}" for c, n in (('l', 'x0'), ('t', 'y0'), ('r', 'x1'), ('u', 'y1')))},
       CASE WHEN d % 5 <> 0 THEN 'original' END AS coordinate_space, CASE WHEN d % 5 = 0 THEN 'no transform from preprocessed to original' END AS space_error
FROM back"""
ORACLE["ocr_mixed_spaces"] = f"""WITH {_WORDS},
spaced AS (SELECT document_id, page_number, count(*) AS n, count(*) FILTER ((line % 5 + block_num) % 3 = 0) AS o FROM line_rows GROUP BY 1, 2)
SELECT document_id, CAST(page_number AS INTEGER) AS page_number, CASE WHEN o = n THEN 'original' WHEN o = 0 THEN 'preprocessed' END AS coordinate_space,
       CASE WHEN o NOT IN (0, n) THEN 'boxes of several coordinate spaces' END AS space_error FROM spaced"""
_PAGES = f"""{_WORDS},
layouts AS (
  SELECT document_id, page_number, '[' || string_agg('{{"text":' || CAST(to_json(text) AS VARCHAR) || ',"bbox":[' || x0 || ',' || y0 || ',' || x1 || ',' || y1 || '],"confidence":'
         || CASE WHEN c > 0 AND c < 0.001 THEN CAST(c * 10000 AS VARCHAR) || 'E-4' ELSE CAST(c AS VARCHAR) END || '}}', ',' ORDER BY line) || ']' AS layout
  FROM (SELECT *, CAST(printf('%.4f', CAST(conf AS DOUBLE) / 100 / n) AS DOUBLE) AS c FROM line_rows) GROUP BY 1, 2),
pages_of AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, unnest(range(1, (len(string_split(text, chr(10))) - 1) // 20 + 3)) AS page_number FROM documents),
joined AS (SELECT p.document_id, p.page_number, r.text AS ocr_text, coalesce(r.n_blocks, 0) AS n_blocks, l.layout
           FROM pages_of p LEFT JOIN page_rows r USING (document_id, page_number) LEFT JOIN layouts l USING (document_id, page_number))"""
ORACLE["page_ocr_join"] = f"WITH {_PAGES} SELECT document_id, CAST(page_number AS INTEGER) AS page_number, ocr_text, CAST(n_blocks AS INTEGER) AS n_blocks FROM joined"
ORACLE["page_select"] = f"""WITH {_PAGES}
SELECT document_id, 3 AS page_number, CAST(NULL AS VARCHAR) AS error FROM pages_of WHERE page_number = 3
UNION ALL SELECT document_id, NULL, 'Page 3 not found in document' FROM pages_of GROUP BY 1 HAVING max(page_number) < 3"""

# ---- queue and prompts ---------------------------------------------------------------------------------------------------

_QUEUE = f"""{_DOCS},
asked AS (
  SELECT document_id, document_type, k, CASE WHEN k % 3 <> 0 THEN 'Who signed ' || document_id || '?' END AS question,
         CASE WHEN k % 4 = 0 THEN 'seen: ' || document_type END AS ocr_text,
         '/scan/' || document_id || CASE WHEN k % 11 = 5 THEN '.unreadable' ELSE '.png' END AS image_path FROM docs),
queue AS (
  SELECT *, CASE WHEN task = 'key_value_extraction' THEN document_type END AS hint,
         CASE WHEN task = 'forgery_detection' THEN 'Unsupported task ''forgery_detection''' WHEN task = 'question_answering' AND question IS NULL
              THEN 'question is required for the question_answering task' END AS reason
  FROM asked CROSS JOIN (SELECT unnest({lits((*dims.ANALYSIS_TASKS, 'forgery_detection'))}) AS task)),
prompted AS (
  SELECT *, CASE task WHEN 'classification' THEN {lit(prompts.CLASSIFY)}
         WHEN 'key_value_extraction' THEN {lit(prompts.FIELDS_FOR)} || {case('document_type', {t: lit(', '.join(dims.DOCUMENT_SCHEMAS[t])) for t in LABELS})} || {lit(prompts.FIELDS_FORM)}
         WHEN 'table_extraction' THEN {lit(prompts.READ_TABLE)} WHEN 'summarization' THEN {lit(prompts.SUMMARISE)} ELSE {lit(prompts.ANSWER)} || question END
         || CASE WHEN ocr_text IS NULL THEN '' ELSE {lit(chr(10) * 2 + prompts.OCR_CONTEXT)} || ocr_text END AS prompt
  FROM queue WHERE reason IS NULL)"""
ORACLE["task_fanout"] = f"WITH {_QUEUE} SELECT document_id, task, hint AS document_type_hint, CASE WHEN reason IS NULL THEN 'ACCEPTED' ELSE 'REJECTED' END AS status, reason FROM queue"
ORACLE["prompt_task"] = f"WITH {_QUEUE} SELECT document_id, task, md5(prompt) AS prompt_md5, ocr_text IS NOT NULL AS ocr_context_used FROM prompted"
_OBJECT_PROMPT = f"""CASE WHEN TRUE THEN {lit(prompts.OBJECT_INTRO)} || {lit(chr(10) * 2 + 'Task: ')} || task || {lit(chr(10) * 2 + 'Page text:' + chr(10))}
  || CASE WHEN coalesce(trim(ocr_text, {WS}), '') = '' THEN {lit(prompts.NO_OCR_TEXT)} ELSE trim(ocr_text, {WS}) END
  || {lit(chr(10) * 2 + 'Page layout:' + chr(10))} || coalesce(layout, {lit(prompts.NO_OCR_BLOCKS)}) || {lit(chr(10) * 2 + 'Instruction: ')} || {case('task', {t: lit(i) for t, i in prompts.OBJECT_INSTRUCTIONS.items()})}
  || {lit(chr(10) * 2 + 'Answer schema:' + chr(10))} || CASE WHEN task = 'document_understanding' THEN {lit(prompts.INVOICE_SCHEMA)} ELSE {lit(prompts.GENERAL_SCHEMA)} END
  || {lit(chr(10) * 2 + prompts.OBJECT_RULES + chr(10) * 2 + prompts.OBJECT_END)} END"""
ORACLE["prompt_object"] = f"""WITH {_PAGES},
tasked AS (SELECT *, {lits(dims.OBJECT_TASKS)}[page_number % {len(dims.OBJECT_TASKS)} + 1] AS task FROM joined)
SELECT document_id, CAST(page_number AS INTEGER) AS page_number, task, md5({_OBJECT_PROMPT}) AS prompt_md5,
       CAST(n_blocks AS INTEGER) AS n_blocks FROM tasked"""
_BASE = ("describe", " Classify", "key_value", "QA", "document_qa", "poem")
ORACLE["prompt_baseline"] = f"""
SELECT c_custkey, prompt_name, md5(prompt) AS prompt_md5, CASE WHEN prompt IS NULL THEN CASE WHEN prompt_name = 'poem' THEN 'Unknown baseline prompt ''poem''' ELSE 'The ''qa'' prompt requires a question' END END AS error
FROM (SELECT c_custkey, prompt_name, CASE prompt_name WHEN 'describe' THEN {lit(prompts.BASELINE_PROMPTS['describe'])} WHEN ' Classify' THEN {lit(prompts.BASELINE_PROMPTS['classify'])}
        WHEN 'key_value' THEN {lit(prompts.BASELINE_PROMPTS['key_value'])} WHEN 'poem' THEN NULL
        ELSE CASE WHEN c_custkey % 2 = 0 THEN {lit(prompts.BASELINE_QUESTION)} || 'Who is ' || c_name || '?' END END AS prompt
      FROM customer CROSS JOIN (SELECT unnest({lits(_BASE)}) AS prompt_name))"""
ORACLE["batch_infer"] = f"""WITH {_QUEUE}
SELECT document_id, task, CASE WHEN bad THEN 'FAILED' ELSE 'RUN' END AS status, CASE WHEN bad THEN 'cannot read ' || image_path END AS error,
       CASE WHEN NOT bad THEN image_path || '|' || length(prompt) END AS response, CASE WHEN NOT bad THEN 'echo' END AS model_name,
       CASE WHEN NOT bad THEN 'cpu' END AS device, CASE WHEN NOT bad THEN length(prompt) / 1000.0::DOUBLE END AS inference_time
FROM (SELECT *, k % 11 = 5 AS bad FROM prompted)"""
ORACLE["analyze_documents"] = f"""WITH {_QUEUE},
done AS (SELECT q.*, length(p.prompt) AS n, q.reason IS NULL AND q.k % 11 <> 5 AS ran
         FROM queue q LEFT JOIN prompted p USING (document_id, task))
SELECT document_id, task, md5(concat_ws('|', CASE WHEN ran THEN 'RUN' ELSE 'FAILED' END,
       CASE WHEN reason IS NOT NULL THEN reason WHEN NOT ran THEN 'cannot read ' || image_path ELSE '-' END,
       CASE WHEN ran AND task = 'classification' THEN 'invoice' WHEN ran THEN coalesce(hint, '-') ELSE '-' END,
       CASE WHEN ocr_text IS NOT NULL THEN 'true' ELSE 'false' END, CASE WHEN ran THEN CAST(n AS VARCHAR) ELSE '-' END, CASE WHEN ran THEN 'true' ELSE '-' END,
       CASE WHEN ran AND task = 'key_value_extraction' THEN CAST(n AS VARCHAR) ELSE '-' END,
       CASE WHEN ran AND task = 'table_extraction' THEN CAST(n AS VARCHAR) ELSE '-' END,
       CASE WHEN ran AND task = 'summarization' THEN n || ' chars' ELSE '-' END,
       CASE WHEN ran AND task = 'question_answering' THEN CAST(n AS VARCHAR) ELSE '-' END)) AS envelope_md5
FROM done"""
ORACLE["infer_resumed"] = f"""WITH {_QUEUE}
SELECT document_id, task, CASE WHEN bad THEN 'FAILED' ELSE 'RUN' END AS status, CASE WHEN bad THEN 'cannot read ' || image_path END AS error,
       CASE WHEN NOT bad THEN image_path || '|' || length(prompt) END AS response, CASE WHEN NOT bad THEN length(prompt) / 1000.0::DOUBLE END AS inference_time,
       CAST(CASE WHEN bad THEN 3 ELSE 1 END AS INTEGER) AS attempts
FROM (SELECT *, k % 11 = 5 AS bad FROM prompted)"""
ORACLE["reply_strip_chat"] = f"SELECT conv_id, turn, trim(text, {WS}) AS response FROM conversations"

# ---- whole documents -----------------------------------------------------------------------------------------------------------

ORACLE["understand_documents"] = f"""WITH {_FILES},{_WORDS},
pg AS (SELECT doc_id, document_id, filename, unnest(range(1, page_count + 1)) AS page_number FROM man WHERE reason IS NULL),
res AS (SELECT pg.*, r.text, coalesce(r.n_blocks, 0) AS n_blocks, filename NOT LIKE '%.PNG' AS parsed
        FROM pg LEFT JOIN page_rows r ON r.document_id = CAST(pg.doc_id AS VARCHAR) AND r.page_number = pg.page_number)
SELECT document_id, 'document_understanding' AS task, 'echo' AS model_id, filename, CAST(count(*) AS INTEGER) AS pages,
       CAST(count(*) FILTER (parsed) AS INTEGER) AS parsed, CAST(count(*) FILTER (parsed) AS INTEGER) AS fields,
       CAST(sum(length(coalesce(text, ''))) AS INTEGER) AS ocr_chars, CAST(sum(n_blocks) AS INTEGER) AS blocks,
       string_agg(CASE WHEN parsed AND coalesce(trim(text, {WS}), '') <> '' THEN 'page with text' ELSE '-' END, ',' ORDER BY page_number) AS summaries
FROM res GROUP BY document_id, filename"""
ORACLE["understand_errors"] = f"""WITH {_FILES}
SELECT document_id, source_path, CASE WHEN reason IS NOT NULL THEN reason WHEN file_type = 'pdf' AND file_size_bytes % 2 <> 0 THEN 'page_count_unknown'
       ELSE 'Page 2 not found in document' END AS error
FROM man WHERE reason IS NOT NULL OR page_count < 2 OR (file_type = 'pdf' AND file_size_bytes % 2 <> 0)"""
ORACLE["eval_unmatched"] = """
SELECT coalesce(l.doc_id, d.doc_id) AS document_id, CASE WHEN d.doc_id IS NULL THEN 'no_truth' ELSE 'no_reply' END AS reason
FROM (SELECT DISTINCT doc_id FROM labels) l FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) d ON l.doc_id = d.doc_id
WHERE l.doc_id IS NULL OR d.doc_id IS NULL"""
