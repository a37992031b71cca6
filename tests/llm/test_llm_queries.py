"""The training-data queries that SQL can express, against their SQL."""

import pytest
from compare import compare

from corpusgraph.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    compare(spark, name, QUERIES[name], ORACLES[name], sf)
