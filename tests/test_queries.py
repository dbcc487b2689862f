"""Every relational query beside its SQL in another engine, on the smallest tables."""

import pytest

from compare import compare
from scorewright.plans.queries import ORACLE_SQL, QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_duckdb(spark, name):
    assert ", equal" in compare(spark, "/root/testdata/sf0.001", name)
