"""Every query with an SQL twin gives the same rows in both engines."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import compare, duck

SMALL = "/root/testdata/sf0.001"
SQLS = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_same_rows(spark, con, name):
    ok, note = compare(spark, con, SMALL, name, queries()[name], SQLS[name])
    assert ok, note


def test_entry_gives_rows(spark):
    assert entry(spark).count() > 0


def test_every_twin_has_a_query():
    from checks.oracles import ORACLES

    assert set(ORACLES) <= set(queries())
