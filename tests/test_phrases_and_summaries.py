"""Phrase tables, the SQL table function, quantile sketches, the cube and wide tables."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docsieve.functions import dims, phrases
from docsieve.functions.phrases import PhraseTable
from docsieve.operators import replies, scoring, tasks

BOOK = "phrase string, document_type string, ordinal int"


def test_phrase_table_equals_the_fixed_phrases(spark):
    rng = random.Random(9)
    known = [p for ps in dims.TYPE_PHRASES.values() for p in ps]
    bits = known + ["billion", "pass", "port", " ", "{", '"type": "', '"', "}", "İ", "id", "card", "PAYSLIP", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(8))) for _ in range(400)] + ['{"document_type": "payslip", "note": "invoice"}', '{"type": "passport"}', "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    plain = sorted(map(repr, tasks.classify_reply(df).collect()))
    for shard in (1000, 4):
        book = PhraseTable(dims.dim_type_phrase(spark), shard)
        assert sorted(map(repr, tasks.classify_reply(df, phrases=book).collect())) == plain


def test_own_phrases(spark):
    rows = [("memo", "letter", 3), ("emo", "feeling", 1), ("memo", "note", 2), ("", "nothing", 0), (None, "nothing", 0), ("a memo", "longer", 9)]
    book = PhraseTable(spark.createDataFrame(rows, BOOK))
    df = spark.createDataFrame([(1, "This is a memo"), (2, "emo"), (3, "none"), (4, "MEMO ")], "i int, response string")
    assert {r.i: r.document_type for r in tasks.classify_reply(df, phrases=book).collect()} == {1: "longer", 2: "feeling", 3: "unknown", 4: "note"}
    empty = PhraseTable(spark.createDataFrame([], BOOK))
    assert {r.document_type for r in tasks.classify_reply(df, phrases=empty).collect()} == {"unknown"}


def test_a_row_crosses_to_python_once_whatever_the_shards(spark):
    """One call per shard made the time grow with rows times phrases; the empty table had none."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abé ") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    book = PhraseTable(spark.createDataFrame([(w, f"t{i % 7}", i % 5) for i, w in enumerate(words)], BOOK), 1)
    assert book.shards <= phrases.FILES
    texts = ["".join(rng.choice("abé cd") for _ in range(rng.randrange(60))) + rng.choice([*words, ""]) for _ in range(200)] + [None, ""]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    plan = found.select("i", book.earliest(F.col("text")).alias("hit"))
    assert len(re.findall(r"run\(text", plan._jdf.queryExecution().optimizedPlan().toString())) == 1
    want = lambda text: min(((text.index(w), i % 5, f"t{i % 7}") for i, w in enumerate(words) if w in text), default=None)
    got = {r.i: r.hit and (r.hit.at - 1, r.hit.ordinal, r.hit.type) for r in plan.collect()}
    assert got == {i: want(t) if t else None for i, t in enumerate(texts)}


def test_time_does_not_depend_on_the_number_of_phrases(tmp_path):
    import ahocorasick

    text = "no word of these occurs here, " * 2000
    took = {}
    for number in (20, 10_000):
        machine = ahocorasick.Automaton()
        for i in range(number):
            machine.add_word(f"phrase number {i:06d}", (20, 0, "t"))
        machine.make_automaton()
        took[number] = min(_timed(lambda: phrases._first(machine, 20, text)) for _ in range(5))
    assert took[10_000] < 10 * took[20]


def test_a_worker_keeps_hashes_and_no_phrases(spark):
    """Each worker held the texts of all phrases, so its memory grew with their length."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abé ") for _ in range(rng.randrange(1, 12))) + str(i % 900) for i in range(4000)]
    book = PhraseTable(spark.createDataFrame([(w, f"t{i % 3}", i) for i, w in enumerate(words)], BOOK), 200)
    index = phrases._Index(book.folder)
    assert not index.known and not hasattr(index, "rows")
    assert index.keys.nbytes + sum(b.table.nbytes for b in index.heads.values()) < 20 * len(words)
    text = "x".join(rng.sample(words, 40)) + "cd"
    assert sorted(r["ordinal"] for r in index.occurring(text)) == [i for i, w in enumerate(words) if w in text]
    assert sorted(index.known) == sorted(set(index.known)) and 0 < len(index.known) < len(words)


def _timed(call):
    start = time.perf_counter()
    call()
    return time.perf_counter() - start


def test_candidates_in_sql(spark):
    replies.register_functions(spark)
    df = spark.createDataFrame([(1, 'x {"a":1} ```json\n{"b":2}\n``` {"a":1}'), (2, "none"), (3, None), (4, "")], "i int, response string")
    df.createOrReplaceTempView("some_replies")
    sql = spark.sql("SELECT i, c.pos, c.candidate FROM some_replies, LATERAL json_candidates(response) c")
    assert sorted(map(tuple, sql.collect())) == sorted(map(tuple, replies.json_candidates(df).collect())) == [(1, 0, '{"b":2}'), (1, 1, '{"a":1}')]


def test_quantiles_of_merged_sketches(spark):
    rng = random.Random(12)
    times = [(i % 40, rng.lognormvariate(0, 1.5), "RUN") for i in range(60_000)] + [(1, 0.0, "RUN"), (2, None, "RUN"), (3, 9e9, "FAILED"), (99, None, "FAILED")]
    runs = spark.createDataFrame(times, "run int, inference_time double, status string").repartition(6)
    sketches = scoring.latency_sketches(runs, "run")
    assert sketches.count() == 41
    got = scoring.latency_quantiles(sketches).first()
    exact = sorted(t for _, t, s in times if s == "RUN" and t)
    assert got.timed_runs == len(exact)
    for q in scoring.QUANTILES:
        rank = sum(t <= got[f"p{q * 100:g}_seconds"] for t in exact) / len(exact)
        assert abs(rank - q) <= scoring.SKETCH_ERROR
    none = scoring.latency_quantiles(sketches.filter("run = 99")).first()
    assert none.timed_runs == 0 and none.p50_seconds is None
    assert scoring.latency_quantiles(sketches.limit(0)).first().p50_seconds is None


def test_cube_with_bounded_lists(spark):
    rows = [("m1", "a", "t", "acc", i / 10, f"s{i}") for i in range(10)] + [("m2", None, "t", "acc", 0.5, "s1"), ("m2", "a", "t", "acc", 0.1, "s2")]
    metrics = spark.createDataFrame(rows, "model string, dataset string, task string, metric string, score double, sample_id string")
    got = {(r.level, r.model, r.dataset, r.task, r.metric): r for r in scoring.bench_cube(metrics, listed=2).collect()}
    total = got[15, None, None, None, None]
    assert total.samples == 12 and [tuple(x) for x in total.lowest] == [(0.0, "s0"), (0.1, "s1")]
    assert got[0, "m2", None, "t", "acc"].mean_score == 0.5  # a null key is a group of its own, not the sum
    assert got[4, "m2", None, "t", "acc"].samples == 2 and max(len(r.lowest) for r in got.values()) == 2
    plan = scoring.bench_cube(metrics)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_wide_tables(spark):
    schema = "reply int, document_type_hint string, response string, field string, amount string"
    df = spark.createDataFrame([
        (1, "invoice", '{"Invoice No": "7", "total": 5, "other": 1}', "own", "own"), (1, "invoice", '{"Invoice No": "7"}', "own", "own"),
        (2, " INVOICE", "nothing", "own", "own"), (3, "salary_slip", '{"emp_id": "9"}', "own", "own"), (4, None, '{"amount": 1}', "own", "own")], schema)
    wide = tasks.kv_wide(df, "invoice")
    assert wide.columns == ["reply", "document_type_hint", "field", "amount", "invoice_number", "customer", "date", "item", "quantity", "invoice_amount"]
    assert sorted((r.invoice_number, r.invoice_amount or "", r.amount) for r in wide.filter("reply = 1").collect()) == [("7", "", "own"), ("7", "5", "own")]
    assert "Exchange" not in wide._jdf.queryExecution().executedPlan().toString()
    assert wide.count() == 3
    assert tasks.kv_wide(df, "identity_document").count() == 0
    with pytest.raises(KeyError):
        tasks.kv_wide(df, "letter")
    assert dict(tasks.kv_wide(df, "salary_slip").drop("field").dtypes)["employee_id"] == "string"


def test_the_cube_keeps_the_lowest_as_rows_come(monkeypatch):
    """Lists of a task over many batches: ties by id, null and odd scores, null ids, groups that come late."""
    import math

    import pyarrow as pa

    from docsieve.functions import partials

    monkeypatch.setattr(partials, "WAITING", 7)
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice("xyz") if i < 700 else f"late {i % 5}", rng.choice([0.0, -0.0, 0.5, 1.0, None, math.nan, math.inf, -math.inf]), rng.choice([None, f"s{i % 90}"])) for i in range(1000)]
    schema = pa.schema([("k", pa.string()), ("metric", pa.string()), ("score", pa.float64()), ("sample_id", pa.string())])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[at:at + 60]), schema)], schema=schema) for at in range(0, len(rows), 60)]
    order = lambda s, i: ((0, 0) if s is None else (2, 0) if math.isnan(s) else (1, s + 0.0), (i is not None, i or ""))
    (part,) = partials.sums_and_lowest(2, 3)(iter(batches))
    got = {(r["k"], r["metric"]): r for r in part.to_pylist()}
    assert set(got) == {r[:2] for r in rows}
    for key, found in got.items():
        own = [r[2:] for r in rows if r[:2] == key]
        assert found["samples"] == sum(s is not None for s, _ in own)
        want = sorted(order(*r) for r in own)[:3]
        assert sorted(order(x["score"], x["sample_id"]) for x in found["lowest"])[:3] == want
        plain = [x for x in found["lowest"] if x["score"] is not None and not math.isnan(x["score"])]
        assert len(plain) <= 3
    assert list(partials.sums_and_lowest(2, 3)(iter([]))) == []


def test_the_cube_reads_its_rows_once(spark):
    """The sums and the lists each made the metrics anew, and all rows once for every combination."""
    metrics = spark.range(500).select(F.lit("m").alias("model"), (F.col("id") % 7).cast("string").alias("dataset"), F.lit("t").alias("task"), F.lit("acc").alias("metric"),
                                      F.when(F.col("id") % 50 != 0, F.col("id") % 9 / 8).alias("score"), F.concat(F.lit("s"), "id").alias("sample_id"))
    cube = scoring.bench_cube(metrics, listed=2)
    assert "Range" not in cube._jdf.queryExecution().optimizedPlan().toString()
    want = {tuple(r) for r in metrics.groupBy("dataset").agg(F.count("score"), F.round(F.avg("score"), 9)).collect()}
    assert {(r.dataset, r.samples, round(r.mean_score, 9)) for r in cube.filter("level = 0").collect()} == want
    top = cube.filter("level = 15").first()
    assert (top.samples, [tuple(x) for x in top.lowest]) == (490, [(None, "s0"), (None, "s100")])
