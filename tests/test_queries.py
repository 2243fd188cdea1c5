"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest

from provenia.plans import registry
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, con, sf, name):
    compare(spark, con, registry.QUERIES[name], registry.ORACLES[name], sf)


def test_merkle_invariants(spark, sf):
    rows = registry.QUERIES["merkle_redact_invariant"](spark, sf).collect()
    assert rows and all(r["root_kept"] and r["proof_ok"] for r in rows) and any(r["hidden"] for r in rows)


def test_flagship(spark):
    import __spark_entry__

    assert {r["reason"] for r in __spark_entry__.entry(spark).collect()} >= {"admitted", "numeral_invented", "unknown_subject"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
