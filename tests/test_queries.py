import pytest

from lodeseek import queries as core
from tests.parity import check

SQL = core.oracle_sql()


def test_every_query_has_sql():
    assert set(core.queries()) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    check(spark, core.queries()[name], SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["path", "title", "score", "mtime"]
