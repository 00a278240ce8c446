"""Every registered query with a closed form against DuckDB on the smallest tables."""

import pytest
from compare import compare, connect

from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries(), oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None
