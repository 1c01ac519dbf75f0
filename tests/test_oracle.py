"""Every registered query against its SQL counterpart on the test tables."""

import pytest
from compare import duck_result, spark_result

from tractloom.registry.oracle import ORACLE_SQL
from tractloom.registry.queries import QUERIES

# An all-NULL column has no type of its own in SQL.
UNTYPED = {'"NULL"', "null"}


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, folder, name):
    kinds, rows = spark_result(QUERIES[name](spark, folder))
    wanted_kinds, wanted = duck_result(duck, ORACLE_SQL[name])
    assert {c: k for c, k in kinds.items()} == {
        c: kinds.get(c) if k in UNTYPED else k for c, k in wanted_kinds.items()
    }
    assert rows
    assert rows == wanted
