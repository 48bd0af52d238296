"""Every query with SQL gives the same rows as DuckDB."""

import pytest

from assay.queries import QUERIES, SQL

from .oracle import duck, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    names, got = spark_rows(QUERIES[name](spark, SF))
    assert (names, got) == duck(SF, SQL[name])
    assert got
