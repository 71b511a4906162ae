"""Derived documents and words lie by document, in as many tasks as there are rows for."""

import datetime

import pytest
from pyspark.sql import functions as F

from docsieve.fixtures import render
from docsieve.operators import ocr
from docsieve.plans import catalog
from docsieve.sources import clustered

DAY = datetime.datetime(2024, 1, 1)
TABLES = {
    "customer": ("c_custkey bigint, c_name string, c_acctbal double", [(i, f"c{i}", float(i)) for i in range(60)]),
    "supplier": ("s_suppkey bigint, s_name string", [(i, f"s{i}") for i in range(5)]),
    "part": ("p_partkey bigint, p_name string", [(i, f"p{i}") for i in range(9)]),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_totalprice double", [(i, i % 60, DAY, i * 1.5) for i in range(200)]),
    "lineitem": ("l_orderkey bigint, l_linenumber int, l_partkey bigint", [(i, n, i % 9) for i in range(200) for n in range(2)]),
    "events": ("event_id bigint, user_id bigint, ts timestamp, event_type string, value double", [(i, i % 7, DAY, "view", i * 0.5) for i in range(300)]),
    "documents": ("doc_id bigint, text string", [(i, f"one {i}\ntwo words\n\nthree") for i in range(300)] + [(300, None), (301, "")]),
}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("spread"))
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_documents_lie_in_tasks_by_their_number(spark, made, monkeypatch):
    """They came in as few tasks as their bytes needed, however many replies each gives."""
    assert render.source_documents(spark, made).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(render, "DOCUMENTS_PER_TASK", 20)
    documents = render.source_documents(spark, made)
    assert documents.rdd.getNumPartitions() == 29 and documents.count() == 200 + 7 + 60 + 5


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count(" Exchange ")


def test_words_are_grouped_without_an_exchange(spark, made):
    """Lines, pages and documents each moved their words once more."""
    words = render.ocr_words(spark, made)
    texts = ocr.ocr_document_text(ocr.ocr_page_text(ocr.ocr_lines(words)))
    assert exchanges(texts) == 1
    assert words.filter("document_id = '7'").count() == 6


def test_stored_words_stay_in_their_tasks(spark, made, monkeypatch):
    """Words were dealt anew over 16 buckets, however many there were."""
    monkeypatch.setattr(render, "TEXTS_PER_TASK", 9)
    buckets = []
    write = clustered.write_words
    monkeypatch.setattr(clustered, "write_words", lambda words, table, number, path: (buckets.append((words, number)), write(words, table, number, path)))
    got = {r.document_id: r.ocr_text for r in catalog.QUERIES["ocr_clustered"](spark, made).collect()}
    (words, number), = buckets
    assert number == 34 == render.word_tasks(spark, made)
    assert exchanges(words.repartition(number, "document_id")) == 1
    direct = ocr.ocr_document_text(ocr.ocr_page_text(ocr.ocr_lines(render.ocr_words(spark, made))))
    assert got == {r.document_id: r.ocr_text for r in direct.collect()} and len(got) > 250


def test_words_stay_where_they_lie_until_their_pages_are_made(spark):
    """The words were sorted to leave out those of other documents, and the table of the pages held every prompt."""
    from docsieve.operators import infer
    from docsieve.plans import understand
    from docsieve.sources import manifest

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = spark.createDataFrame([("/in/a.png", 9, None), ("/in/b.txt", 9, None)], "source_path string, file_size_bytes bigint, page_count int")
    known = manifest.manifest_validate(listed)
    ids = spark.createDataFrame([("/in/a.png", "yes"), ("/in/b.txt", "no")], "path string, text string").select(manifest.document_id(F.col("path")).alias("document_id"), "text")
    words = ids.repartition(n, "document_id").select(
        "document_id", F.lit(1).alias("page_number"), F.lit(0).alias("word_idx"), "text", F.lit(90.0).alias("conf"), F.lit(0).alias("block_num"), F.lit(1).alias("par_num"),
        F.lit(0).alias("line_num"), F.lit(1).alias("page_num"), *[F.lit(1).alias(c) for c in ("left", "top", "width", "height")])
    factory = infer.echo_predictor_factory(reply=lambda image, prompt: '{"summary": "s"}')
    with_plan = understand.understand_pages(known, words, "document_understanding", factory)
    plan = with_plan._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [document_id" in plan
    # between the words and their lines there is no exchange but the one that they lie by
    lines = plan[plan.index("collect_list(struct(word_idx"):]
    assert "prompt" in with_plan.columns and "prompt" not in understand.FOLDED
    assert "Exchange" not in lines[:lines.index("ShuffledHashJoin")]
    (done,) = understand.understand_documents(known, words, "document_understanding", factory).collect()
    assert (done.metadata.filename, [p.text for p in done.ocr], [r.summary for r in done.results]) == ("a.png", ["yes"], ["s"])
