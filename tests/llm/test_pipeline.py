"""Pipeline stages against brute force, and the queries against their SQL twins."""

import os
import re

import duckdb
import pytest
from comparing import same_rows
from test_dedup import expected_near

import __spark_entry__ as entry_points
import corpus_pipeline
from docsieve.llm import quality
from docsieve.llm.queries import ORACLE, QUERIES, quality_weights

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "pages", "labels", "embeddings", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    cursor = duck.execute(entry_points.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert same_rows([tuple(r) for r in df.select(*columns).collect()], cursor.fetchall())


def test_all_queries_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert {*QUERIES, "pipeline"} <= set(entry_points.queries())


def test_stages(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    tables = {"documents": documents.collect()}
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        tables[name] = out.collect()
        if name != names[-1]:
            assert out.columns == documents.columns
            docs = spark.createDataFrame(tables[name], documents.schema)
    good, exact, near, mixed, packed = (tables[n] for n in names)
    accepted = {r.doc_id for r in quality.classify(documents, labels).collect() if r.predicted}
    assert same_rows(good, [r for r in tables["documents"] if r.doc_id in accepted])
    last = {}
    for r in good:
        last[r.text] = max(last.get(r.text, r.doc_id), r.doc_id)
    assert same_rows(exact, [r for r in good if last[r.text] == r.doc_id])
    kept = {r[0] for r in expected_near([(r.doc_id, r.text) for r in exact], 5, 80) if r[3]}
    assert same_rows(near, [r for r in exact if r.doc_id in kept])
    size = lambda rows: sum(len(WORDS.findall(r.text or "")) for r in rows)
    assert abs(size(mixed) - 1.5 * size(near)) < 1 + len({r.source for r in near})
    by = {r.doc_id: r for r in near}
    for r in mixed:
        whole = WORDS.findall(by[r.doc_id].text)
        own = WORDS.findall(r.text)
        assert own == whole[: len(own)] and (r.text == by[r.doc_id].text or len(own) < len(whole))
    # a token sequence for all of the mix, documents as often as they are in it
    assert sorted(r.doc_id for r in packed if r.piece == 0) == sorted(r.doc_id for r in mixed)
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096


def test_run_equals_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    again = corpus_pipeline.run(spark, SF_DIR).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert rows and same_rows(map(key, rows), map(key, again))


def test_stages_on_odd_tables(spark, docs, no_docs, tmp_path):
    """Nulls, repeated rows and an empty table pass every stage."""
    spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[1:] if table is docs else corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            if out.columns == table.columns:
                table = spark.createDataFrame(out.collect(), table.schema)
            else:
                assert bool(out.collect()) == bool(table.collect())


def test_quality_weights(spark):
    assert {r.quality_weight for r in quality_weights(spark, SF_DIR).collect()} <= {1.0, 0.25}
