import pytest
from conftest import SMALL, same

from tarnwick import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, SMALL).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df())


def test_every_query_without_sql_runs(spark):
    for name in set(registry.QUERIES) - set(registry.ORACLE_SQL):
        assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
