"""Every registered query of the library with SQL gives DuckDB's rows on the smallest tables."""

import pytest
from oracle import same_rows

from tessera.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    same_rows(spark, SF, QUERIES[name], ORACLES[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
