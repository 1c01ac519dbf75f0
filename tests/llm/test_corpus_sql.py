"""Corpus queries against their SQL counterparts on the test tables."""

import pytest
from compare import duck_result, spark_result

from tractloom.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, folder, name):
    kinds, rows = spark_result(QUERIES[name](spark, folder))
    wanted_kinds, wanted = duck_result(duck, ORACLE_SQL[name])
    assert kinds == wanted_kinds
    assert rows
    assert rows == wanted
