"""One key holding a third of all rows: the same whole results."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from docsieve.fixtures import render
from test_catalog import SF_DIR, TABLES, canonical

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
HOT = {"events": ("user_id", 7), "lineitem": ("l_orderkey", 5), "orders": ("o_custkey", 3)}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    connection = duckdb.connect()
    for name in TABLES:
        source = f"(SELECT *, row_number() OVER () AS n FROM '{SF_DIR}/{name}.parquet')"
        column, key = HOT.get(name, (None, None))
        replace = f"REPLACE (CASE WHEN n % 3 = 0 THEN {key} ELSE {column} END AS {column})" if column else ""
        connection.execute(f"COPY (SELECT * EXCLUDE (n) {replace} FROM {source}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), connection


@pytest.mark.parametrize("name", ["field_accuracy_by_type", "table_cells_pipe", "table_accuracy_micro", "structured_parse"])
def test_hot_keys_give_whole_results(spark, skewed, name):
    folder, connection = skewed
    df = entry_points.queries()[name](spark, folder)
    cursor = connection.execute(entry_points.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert canonical(df.columns, df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, columns, cursor.fetchall())


def test_statement_groups_stay_bounded(spark, skewed):
    statements = render.statements(spark, skewed[0])
    assert statements.select(F.max(F.size("expected_rows"))).first()[0] <= render.EVENT_BLOCK
