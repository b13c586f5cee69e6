"""Every query of the library against its SQL counterpart on the smallest tables; `tests/llm` covers those of `llm`."""

import duckdb
import pytest

import __spark_entry__ as driver
from packetweave.checks import oracle, queries

TABLES = ["events"]
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
QUERIES, SQL = queries.registered(), oracle.statements()


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    return connection


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)
    known = driver.queries()
    assert set(driver.oracle_sql()) <= set(known) and set(QUERIES) <= set(known)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    frame = QUERIES[name](spark, small)
    names = sorted(frame.columns)
    rows = [tuple(r[c] for c in names) for r in frame.collect()]
    if name not in SQL:
        assert rows
        return
    expected = duck.sql(SQL[name])
    assert sorted(expected.columns) == names
    types = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: TYPES[t] for c, t in frame.dtypes} == types
    order = [expected.columns.index(c) for c in names]
    wanted = [tuple(r[i] for i in order) for r in expected.fetchall()]
    assert sorted(rows, key=repr) == sorted(wanted, key=repr)


def test_entry(spark):
    assert driver.entry(spark).columns == ["frame_number", "cluster_id", "anomaly_score", "is_anomaly"]
