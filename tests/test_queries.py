"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

import pytest

from compare import same
from conftest import SF
from sparkloom.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    same(catalogue.queries()[name](spark, SF), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_rows_only(spark, name):
    assert catalogue.queries()[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
