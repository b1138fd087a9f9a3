"""Every registered query against its SQL, over the whole smallest tables."""

import pytest

import __spark_entry__ as entry
from shelfspark.plans.registry import ORACLES, QUERIES
from tools.check import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con, sf_dir):
    ok, message = compare(spark, con, sf_dir, QUERIES[name], ORACLES.get(name))
    assert ok, message


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["id", "embedding", "document", "metadata"]
    assert rows.count() == 168
