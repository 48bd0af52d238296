"""Registered queries equal their SQL over whole tables."""

import pytest

from assay.llm.queries import oracle_sql, queries
from tests.oracle import duck, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    assert spark_rows(queries()[name](spark, SF)) == duck(SF, oracle_sql()[name])
