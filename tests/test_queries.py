from __future__ import annotations

import pytest

from mnemion.plans import registry
from tests.compare import TESTDATA, assert_same

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert_same(spark, registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    rows = registry.queries()[name](spark, TESTDATA).collect()
    assert rows and rows[0].__fields__


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
