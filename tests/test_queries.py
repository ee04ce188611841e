import pytest
from compare import assert_same
from conftest import SMALL

from factloom import queries

ALL, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(ALL[name](spark, SMALL), SQL[name], SMALL)


def test_every_query_has_sql_or_a_reason():
    assert set(ALL) == set(SQL)


def test_location_join_is_an_equality_join(spark, capsys):
    ALL["join_03_location"](spark, SMALL).explain("formatted")
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PushedFilters" in plan
