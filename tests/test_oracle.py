"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from strataspark.plans.catalogue import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, duck, name):
    df, rel = queries()[name](spark, DATA), duck.sql(oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    for c in cols:
        kind = df.schema[c].dataType.simpleString()
        assert KINDS.get(kind, str(rel.types[rel.columns.index(c)])) == str(rel.types[rel.columns.index(c)]), c
    at = [rel.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_others_run(spark, name):
    rows = queries()[name](spark, DATA).collect()
    assert rows
    if name == "geotiff_roundtrip":
        assert rows[0]["n_differ"] == 0 and rows[0]["n"] == 200
