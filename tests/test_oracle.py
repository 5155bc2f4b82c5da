"""Every registered query of the library gives what its SQL gives in DuckDB."""

import pytest
from oracle import difference

from edgeloom.plans import registry

SF = "/root/testdata/sf0.001"
#: Empty at this scale: these are compared where they have rows.
LARGER = {"g4_neighbourhood", "g6_opposing_edges"}
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    sf = "/root/testdata/sf0.01" if name in LARGER else SF
    assert difference(spark, QUERIES[name], SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
