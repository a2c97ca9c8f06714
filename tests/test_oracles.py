"""Every query of the engine against its SQL on the smallest tables."""

import pytest

from patchlake.plans import registry

from compare import check, connection

FOLDER = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    check(spark, con, FOLDER, name, registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).collect() is not None
