"""Every query of the catalogue gives the rows of its SQL."""

import pytest

from conftest import same_rows
from ndgrid import catalog


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLE_SQL])
def test_query_matches_sql(spark, sf, duck, name):
    same_rows(catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL])
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_points(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
