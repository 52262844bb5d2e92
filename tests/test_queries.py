"""Every registered query against its SQL counterpart on the smallest tables."""

import oracle
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from tidemark.workload.oracles import ORACLES
from tidemark.workload.queries import QUERIES


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SMALL)


def test_entry_has_every_query():
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    columns, rows = oracle.spark_rows(QUERIES[name](spark, SMALL))
    want_columns, want_rows, _ = oracle.sql_rows(duck, ORACLES[name])
    assert columns == want_columns
    assert rows == want_rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
