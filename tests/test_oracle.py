from __future__ import annotations

import pytest

import oracle
from __spark_entry__ import entry, oracle_sql, queries

Q, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, con, spark, sf_dir):
    oracle.compare(con, spark, Q[name], SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_runs(name, spark, sf_dir):
    assert Q[name](spark, sf_dir).count() >= 0


def test_entry(spark):
    assert entry(spark).count() == 19
