"""Every query of the engine against the same as SQL on DuckDB."""

import pytest
from conftest import canonical
from tidemark.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 12
    assert set(e.oracle_sql()) <= set(e.queries())
