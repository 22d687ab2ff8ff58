import pytest
from oracle import compare

from graphloom.plans.registry import SQL, relational_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, name):
    compare(relational_queries()[name](spark, SF), SQL[name], SF)
