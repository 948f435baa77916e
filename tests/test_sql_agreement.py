"""Every registered query against its SQL on the smallest tables.

Queries of the analysis share one run per tracker here, so each stage is written once.
"""

import functools

import pytest

import __spark_entry__ as entry
from catalog.registry import QUERIES, SQL
from catalog import analysis_queries as A
from compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.fixture(scope="module", autouse=True)
def one_run_per_tracker():
    kept = A.browser, A.second
    A.browser, A.second = (functools.cache(f) for f in kept)
    yield
    A.browser, A.second = kept


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees(spark, db, name):
    good, note = compare(spark, db, SF_DIR, QUERIES[name], SQL[name])
    assert good, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
