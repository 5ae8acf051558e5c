"""Every registered query against its SQL on the smallest test tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_module

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
KEYS = {"lam", "pid", "gid", "qid", "rank", "ix", "iy", "iz", "bin", "ibin", "i"}
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


ENGINE = {q.__name__: q for q in entry_module._QUERIES}


def test_every_query_has_sql():
    assert set(ENGINE) == set(entry_module._engine_sql())
    assert set(ENGINE) <= set(entry_module.queries())


@pytest.mark.parametrize("name", list(ENGINE))
def test_query(spark, duck, name):
    df = ENGINE[name](spark, SF_DIR)
    relation = duck.sql(entry_module._engine_sql()[name])
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(relation.columns, map(str, relation.types)))
    columns = sorted(df.columns)
    key = [c for c in columns if c in KEYS] or columns
    got = df.toPandas()[columns].sort_values(key).to_numpy(float)
    want = relation.df()[columns].sort_values(key).to_numpy(float)
    np.testing.assert_array_equal(got, want)
