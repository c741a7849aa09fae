import random

import pytest
from pyspark.sql import functions as F

from sieveline.llm import topk

SCHEMA = "id long, code long"


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def brute(codes, queries, k):
    out = []
    for q, c in sorted({r for r in queries if None not in r}):
        near = {}
        for i, d in codes:
            if i is not None and d is not None and i != q:
                near[i] = min(near.get(i, 99), bin((c ^ d) & (2**64 - 1)).count("1"))
        best = sorted((d, i) for i, d in near.items())[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("segments", [2, 4, 8])
def test_against_brute_force_with_ties_and_hot_codes(spark, segments):
    random.seed(segments)
    base = [random.getrandbits(64) for _ in range(5)]
    codes = [(i, signed(random.choice(base) ^ sum(1 << random.randrange(64) for _ in range(random.randrange(4))) & (2**64 - 1))) for i in range(300)]
    codes += [(i, signed(base[0])) for i in range(300, 420)] + [(500, None), (None, 5), (301, signed(base[0]))]
    queries = [c for c in codes if c[0] is not None and c[0] % 20 == 0]
    got = topk.nearest(spark.createDataFrame(codes, SCHEMA), spark.createDataFrame(queries, SCHEMA), 7, segments).collect()
    assert sorted(tuple(r) for r in got) == brute(codes, queries, 7)


def test_fewer_rows_than_k_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0), (2, -1), (3, 5)], SCHEMA)
    got = sorted(tuple(r) for r in topk.nearest(df, df, 10, 4).collect())
    assert got == brute([(1, 0), (2, -1), (3, 5)], [(1, 0), (2, -1), (3, 5)], 10)
    assert topk.nearest(df.limit(0), df, 3).collect() == [] and topk.nearest(df, df.limit(0), 3).collect() == []


def test_codes(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.5],), ([None, float("nan"), 2.0],), (None,), ([],), ([1.0] * 64,)], "v array<float>")
    assert [r[0] for r in df.select(topk.sign_code(F.col("v"))).collect()] == [5, 4, None, 0, -1]
    with pytest.raises(Exception, match="project longer vectors"):
        spark.createDataFrame([([1.0] * 65,)], "v array<float>").select(topk.sign_code(F.col("v"))).collect()
