import os

import pytest
from helpers import DATA, duckdb_rows, spark_rows

from quillon.llm import queries as Q

SF = "sf0.001"
SQL = Q.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(f"{DATA}/{SF}"), reason="no test data")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    columns, got = spark_rows(Q.queries()[name](spark, f"{DATA}/{SF}"))
    assert got == duckdb_rows(SQL[name], SF, columns)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(SQL)))
def test_the_others_run_over_the_tables(spark, name):
    assert Q.queries()[name](spark, f"{DATA}/{SF}").count() > 0
