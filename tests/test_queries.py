"""Every query with SQL against DuckDB on the same tables; the others run."""

import pytest
from compare import differences

from corpuscope.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, name):
    if name in SQL:
        assert differences(spark, sf_dir, QUERIES[name], SQL[name]) in ({}, {"rows": 0})
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
