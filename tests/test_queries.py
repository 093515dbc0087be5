"""Every core query against its SQL counterpart on the smallest tables."""

from __future__ import annotations

import pytest

from tests.oracle import connect, same
from tidalframe.plans import registry


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(name, spark, sf_dir, db):
    got, want = same(registry.QUERIES[name](spark, sf_dir), db, registry.ORACLE_SQL[name])
    assert got == want


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_entry_and_registry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
