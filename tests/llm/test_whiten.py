import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sieveline.llm")
from sieveline.llm import whiten as W  # noqa: E402
from sieveline.llm.queries import QUERIES  # noqa: E402


def brute(vectors, k=8):
    """Integer grid, exact sums, numpy's own eigenvectors."""
    x = [[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    away = [[n * r[i] - sums[i] for i in range(d)] for r in x]
    centred = np.array(away, dtype=float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    return n, [sum(a * a for a in r) for r in away], values[order], axes[:, order], centred, values.sum()


def test_the_query_against_numpy(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, far, values, axes, centred, trace = brute([r.embedding for r in rows])
    got = QUERIES["op11_embedding_whitening"](spark, sf_dir).toPandas()
    assert len(got) == 8 * n and set(got.n) == {n} and got.identity_error.nunique() == 1
    assert got.identity_error.iloc[0] < 1e-9
    assert dict(zip(got.vec_id, got.deviation)) == {r.vec_id: f for r, f in zip(rows, far)}
    for c in range(8):
        part = got[got.component == c + 1].set_index("vec_id").loc[[r.vec_id for r in rows]]
        assert np.allclose(part.explained, values[c] / trace, rtol=1e-10)
        want = centred @ axes[:, c] / np.sqrt(values[c])
        sign = np.sign(want @ part.whitened)
        assert np.allclose(part.whitened, sign * want, atol=1e-8)


def test_nulls_repeats_clashes_and_large_entries(spark):
    rng = np.random.default_rng(3)
    good = [[float(v) for v in r] for r in rng.normal(size=(30, 4))]
    good[7] = [1e6, -2e6, 3e8, 0.5]
    bad = [None, [], [1.0, None, 2.0, 3.0], [float("nan")] * 4, [1.0, float("inf"), 0.0, 0.0], [1e30] * 4, [1.0, 2.0]]
    rows = [(i, v, 1.0, 2) for i, v in enumerate(good)] + [(3, good[3], 1.0, 2), (None, good[5], 1.0, 2)]
    used = [r[1] for r in rows]
    rows += [(100 + i, v, 0.0, 0) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened double, n int")
    n, far, values, axes, centred, trace = brute(used, 3)
    got = W.whiten(df.repartition(5), k=3).toPandas()
    assert len(got) == 3 * n == 96 and set(got.component) == {1, 2, 3}
    assert sorted(map(int, got[got.component == 1].deviation)) == sorted(far)
    assert np.allclose(got[got.component == 1].explained, values[0] / trace)
    assert W.whiten(df.where("vec_id >= 100")).count() == 0
    assert W.whiten(df.limit(0)).count() == 0
    assert W.whiten(df.where("vec_id = 3")).count() == 0
    with pytest.raises(ValueError):
        W.whiten(df.withColumnRenamed("n", "x").withColumnRenamed("vec_id", "n"), "n")


def test_components_of_a_rank_deficient_table(spark):
    rng = np.random.default_rng(5)
    base = np.floor(rng.normal(size=(200, 2)) * [640, 64]) / 64
    wide = np.c_[base, base[:, 0], base[:, 1] * 2]
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(wide)], "vec_id long, embedding array<double>")
    got = W.whiten(df, k=8).toPandas()
    assert set(got.component) == {1, 2} and got.identity_error.max() < 1e-9
    assert got.groupby("component").explained.first().sum() == pytest.approx(1.0)


def test_cholesky_and_jacobi():
    rng = np.random.default_rng(1)
    m = rng.integers(-9, 9, size=(7, 5))
    a = m @ m.T
    factor = W.pivoted_cholesky(a)
    assert factor.shape == (7, 5) and np.allclose((factor @ factor.T).astype(float), a)
    values, axes = W.one_sided_jacobi(factor)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(a.astype(float)))[::-1][:5]) and np.allclose(axes.T @ axes, np.eye(5), atol=1e-14)
    assert np.allclose(axes @ np.diag(values) @ axes.T, a)
    for r in (1, 2, 5, 8):
        pairs = [tuple(sorted(p)) for i, j in W._rounds(r) for p in zip(i, j)]
        assert len(pairs) == len(set(pairs)) == r * (r - 1) // 2


def test_the_partitioning_does_not_matter(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one = W.whiten(df.coalesce(1), k=2).agg(F.sum("deviation"), F.max("explained")).first()
    assert one == W.whiten(df.repartition(7), k=2).agg(F.sum("deviation"), F.max("explained")).first()
