import pytest
from compare import duck_rows, spark_rows

from inkfall.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, small, name):
    assert spark_rows(QUERIES[name](spark, small)) == duck_rows(duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    QUERIES[name](spark, small).collect()
