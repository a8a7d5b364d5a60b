"""Every registered query against its SQL twin; queries without one must yield rows."""

import os

import oracle
import pytest
from siltstone.plans.catalog import load_all

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = load_all()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    q = QUERIES[name]
    if q.sql is None:
        assert not q.run(spark, SF_DIR).isEmpty()
    else:
        assert oracle.compare(q.run(spark, SF_DIR), duck, q.sql) == []


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.FLAGSHIP in e.oracle_sql()
