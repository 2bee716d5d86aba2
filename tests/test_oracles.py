"""Every query with SQL gives the rows that DuckDB gives."""

import pytest

from nothi.plans import catalog
from tests.compare import connect, same

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, con, name):
    same(catalog.queries()[name](spark, sf_dir), SQL[name], con)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(SQL)
