"""Registered queries against DuckDB on the given tables, awkward rows and empty tables."""

import duckdb  # noqa: F401
import pytest
from support import rows_of

import corpus_pipeline
from packetweave.llm import oracle, queries

QUERIES, SQL = queries.registered(), oracle.statements()


@pytest.mark.parametrize("name", sorted(SQL))
def test_given_tables(spark, small, by_sql, name):
    assert rows_of(QUERIES[name](spark, small)) == by_sql(small, SQL[name])


@pytest.mark.parametrize("name", sorted(SQL))
def test_awkward_rows(spark, awkward_dir, by_sql, name):
    assert rows_of(QUERIES[name](spark, awkward_dir)) == by_sql(awkward_dir, SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, small, name):
    found = QUERIES[name](spark, empty_dir)
    assert found.collect() == []
    assert found.dtypes == QUERIES[name](spark, small).dtypes


def test_pipeline_on_empty_and_awkward_tables(spark, empty_dir, awkward_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []
    assert {r.doc_id for r in corpus_pipeline.run(spark, awkward_dir).collect()} <= {1, -3, *range(2, 19)}
