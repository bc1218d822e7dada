"""Every registered query with SQL gives the rows of its SQL."""

import pytest

from loomgraph.plans.queries import ORACLES, QUERIES
from tests.oracle import actual, expected

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    want, got = expected(ORACLES[name], SF), actual(QUERIES[name](spark, SF))
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1], "an empty result shows nothing"
