"""Every registered query runs; those with SQL give the same rows in DuckDB."""

import os

import oracle_check
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_check.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    n, same, note = oracle_check.compare(spark, con, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert same is not False, note
    assert n >= 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
