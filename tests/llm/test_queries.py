"""Queries that SQL can express, against their twins; the rest must run and fit their contract."""

import pytest

pytest.importorskip("sieveline.llm")
from oracle import compare, connect  # noqa: E402

from sieveline.llm.queries import ORACLE, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_against_sql(spark, name, size):
    sf_dir = f"/root/testdata/{size}"
    said, n = compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name])
    assert said.startswith("ok") and n > 0
