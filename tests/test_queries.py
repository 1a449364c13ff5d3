"""Every registered query of the engine against its SQL on the smallest tables."""

import pytest

from compare import duck, rows_of, rows_of_sql
from lodestone.plans import queries as _  # noqa: F401
from lodestone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    columns, rows = rows_of(registry.queries()[name](spark, SF))
    assert rows
    if sql := registry.oracle_sql().get(name):
        assert (columns, rows) == rows_of_sql(con, sql)
