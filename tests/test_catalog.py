"""Every registered query with a SQL twin agrees with it on whole tables."""

import oracle
import pytest

from sieveline.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, con, name):
    result, _ = oracle.compare(QUERIES[name](spark, sf_dir), con, ORACLE[name])
    assert result.startswith("ok"), result


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
