import pytest

import __spark_entry__
from tests.compare import same
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(__spark_entry__.CATALOGUE))
def test_query_agrees_with_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        same(df, duck, sql)
    else:
        assert df.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
