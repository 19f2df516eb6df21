"""Every query with oracle SQL gives the oracle's rows; the others give rows."""

import pytest

import __spark_entry__ as entry
import oracle

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    rows, problems = oracle.compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert not problems, problems
    assert rows > 0


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "items" in df.columns
