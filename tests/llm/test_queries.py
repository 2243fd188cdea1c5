"""The queries that SQL can express against their SQL."""

import pytest

from provenia.llm import registry
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sf, name):
    compare(spark, connect(sf), registry.QUERIES[name], registry.ORACLES[name], sf)
