import pytest
from oracle import spark_rows, sql_rows

from rankloom.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(set(SQL) - {"p7_found"}))
def test_equals_sql(spark, data, name):
    assert spark_rows(QUERIES[name](spark, data)) == sql_rows(SQL[name], data)
