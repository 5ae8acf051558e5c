import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from boxstats.llm import queries
from tests.llm.data import same

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_all_operators_are_registered():
    names = entry_module.queries()
    assert [n for i in range(1, 14) for n in names if n.startswith(f"op{i}_")] == list(queries.queries())
    assert "pipeline" in names
    assert set(queries.oracle_sql()) < set(names)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_equal_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = queries.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    want = connection.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    same(df.select(*columns).collect(), want.select(*columns).fetchall())


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in queries.oracle_sql()])
def test_every_document_has_its_row(spark, name):
    docs = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect()}
    df = queries.queries()[name](spark, SF_DIR)
    got = [r.doc_id for r in df.select("doc_id").collect()]
    assert set(got) == docs and (name.startswith("op3_") or len(got) == len(docs))
