"""Boosted trees against a plain trainer that tries every value of every feature."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline import settings as S
from sieveline.operators import boosting as B
from sieveline.operators import splits as P

FEATURES = ("a", "b", "c", "d")


def made(n=240, seed=5):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((n, 4)), 2)
    x[:, 3] = rng.integers(0, 3, n)
    y = ((x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.random(n) + 0.1 * x[:, 3]) > 0.95).astype(int)
    return x, y


@pytest.fixture(scope="module")
def data(spark):
    x, y = made()
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "company_id long, label int, a double, b double, c double, d double").repartition(3)


def pull(g, p):
    return np.sign(g) * max(abs(g) - p.l1, 0)


def score(g, h, p):
    return pull(g, p) ** 2 / (h + p.l2)


def plain_tree(x, g, h, p, depth=0):
    """(value,) of a leaf or (gain, feature, cut, left, right)."""
    leaf = (-p.learning_rate * pull(g.sum(), p) / (h.sum() + p.l2),)
    if depth == p.depth:
        return leaf
    best = (B.LEAST_GAIN, None)
    for j in range(x.shape[1]):
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            if min(h[left].sum(), h[~left].sum()) < p.min_child_weight:
                continue
            gain = score(g[left].sum(), h[left].sum(), p) + score(g[~left].sum(), h[~left].sum(), p) - score(g.sum(), h.sum(), p)
            if gain > best[0] + 1e-9:
                best = (gain, j, cut)
    if best[1] is None:
        return leaf
    gain, j, cut = best
    left = x[:, j] <= cut
    sides = [plain_tree(x[s], g[s], h[s], p, depth + 1) for s in (left, ~left)]
    if all(len(s) == 1 for s in sides) and gain < p.loss_reduction:
        return leaf
    return (gain, j, cut, *sides)


def walk(tree, row):
    while len(tree) > 1:
        tree = tree[3] if row[tree[1]] <= tree[2] else tree[4]
    return tree[0]


def plain_margins(x, y, p):
    m = np.zeros(len(y))
    w = np.where(y == 1, p.positive_weight, 1.0)
    for _ in range(p.trees):
        q = 1 / (1 + np.exp(-m))
        tree = plain_tree(x, w * (q - y), w * q * (1 - q), p)
        m = m + np.array([walk(tree, r) for r in x])
    return m


FULL = dict(row_sample=1.0, column_sample=1.0)


@pytest.mark.parametrize(
    "params",
    [
        S.BoostParams(trees=12, depth=3, learning_rate=0.3, **FULL),
        S.BoostParams(trees=4, depth=5, learning_rate=0.5, min_child_weight=3, loss_reduction=1.0, positive_weight=1.7, **FULL),
        S.BoostParams(trees=3, depth=2, learning_rate=0.5, l1=2.0, l2=5.0, **FULL),
    ],
)
def test_against_the_plain_trainer(data, params):
    model = B.fit_many(data, FEATURES, [B.Fit(params)], "company_id")[0]
    x, y = made()
    want = plain_margins(x, y, params)
    assert np.allclose(model.margins(x), want, atol=1e-4)
    loss = np.where(y == 1, params.positive_weight, 1.0) * (np.logaddexp(0, want) - y * want)
    assert model.losses[-1][0] == pytest.approx(loss.sum() / np.where(y == 1, params.positive_weight, 1.0).sum(), abs=1e-4)
    assert len(model.losses) == params.trees + 1 and model.losses[0][0] == pytest.approx(np.log(2), abs=1e-6)


def test_models_fitted_together_are_those_fitted_alone(data):
    fits = [
        B.Fit(S.BoostParams(trees=11, depth=3, learning_rate=0.3), "company_id % 3 <> 0"),
        B.Fit(S.BoostParams(trees=5, depth=4, learning_rate=0.2, column_sample=0.5, seed=7)),
        B.Fit(S.BoostParams(trees=2, depth=1), "company_id < 0"),
    ]
    together = B.fit_many(data, FEATURES, fits, "company_id")
    x, _ = made()
    for f, m in zip(fits, together):
        alone = B.fit_many(data.repartition(5), FEATURES, [f], "company_id")[0]
        assert (alone.margins(x) == m.margins(x)).all() and len(m.trees) == f.params.trees
    assert (together[2].margins(x) == 0).all()
    used = {int(f) for f in together[1].trees[0].feature if f >= 0}
    assert len(used) <= 2


def test_patience_ends_boosting_and_keeps_the_best_round(data):
    params = S.BoostParams(trees=60, depth=5, learning_rate=0.8, min_child_weight=0, l2=0.1, **FULL)
    fit = B.Fit(params, "company_id % 4 <> 0", "company_id % 4 = 0", 5)
    model = B.fit_many(data, FEATURES, [fit], "company_id")[0]
    seen = [v for _, v in model.losses[1:]]
    assert model.best_round == int(np.argmin(seen)) + 1 == len(model.trees)
    assert len(seen) == min(model.best_round + 5, 60) < 60
    x, y = made()
    held = np.arange(len(y)) % 4 == 0
    m = model.margins(x[held])
    assert np.mean(np.logaddexp(0, m) - y[held] * m) == pytest.approx(min(seen), abs=1e-5)


def test_quantile_bins_of_a_long_feature(spark):
    rows = spark.range(3000).select(F.col("id").alias("company_id"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") / 7).alias("a"), F.lit(1.0).alias("b"))
    cuts = B.cut_points(rows, ("a", "b"), 16)
    assert len(cuts[0]) == 15 and len(cuts[1]) == 0
    assert np.allclose(np.diff(cuts[0]), 3000 / 7 / 16, atol=2)


def test_saved_models_score_the_same(spark, data, tmp_path):
    model = B.fit_many(data, FEATURES, [B.Fit(S.BoostParams(trees=3, depth=3))], "company_id")[0]
    B.save(spark, model, str(tmp_path / "m"))
    again = B.load(spark, str(tmp_path / "m"))
    x, _ = made()
    assert (again.margins(x) == model.margins(x)).all() and again.params == model.params and again.losses == model.losses
    assert np.allclose(again.importances(), model.importances()) and model.importances().sum() == pytest.approx(1)


def test_stratified_folds_and_split(many_partitions):
    rows = many_partitions.range(103).select(F.col("id").alias("k"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    folds = P.with_stratified_folds(rows, "k", "y", 4).groupBy("y", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r.y == label]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    again = P.with_stratified_folds(rows.repartition(6), "k", "y", 4).collect()
    assert {(r.k, r.fold) for r in again} == {(r.k, r.fold) for r in P.with_stratified_folds(rows, "k", "y", 4).collect()}
    missing = rows.withColumn("y", F.when(F.col("k") < 100, F.col("y")))
    got = P.with_exact_split(missing, "k", "y", 0.25)
    assert got.count() == 103 and got.where("y is null and is_test").count() == 0


def test_driver_gets_splits_and_no_histograms(spark, data, monkeypatch):
    """Of a pass the driver reads a row per open node or loss, whatever the number of tasks and bins."""
    monkeypatch.setattr(B, "TASK_ROWS", 50)
    monkeypatch.setattr(B, "MERGE_BYTES", 20_000)
    monkeypatch.setattr(B, "BLOCK_ROWS", 64)
    seen = []
    collect = type(data).collect

    def watched(self):
        got = collect(self)
        seen.append((len(got), sum(len(v) for r in got for v in r if isinstance(v, (bytes, bytearray)))))
        return got

    whole = [B.Fit(S.BoostParams(trees=3, depth=3)), B.Fit(S.BoostParams(trees=2, depth=3, seed=5))]
    alone = B.fit_many(data, FEATURES, whole, "company_id")
    monkeypatch.setattr(type(data), "collect", watched)
    split = B.fit_many(data.repartition(8), FEATURES, whole, "company_id")
    assert seen and all(size == 0 for _, size in seen)
    assert max(n for n, _ in seen) <= sum(2 ** (f.params.depth - 1) + 2 for f in whole)
    assert [repr(m.trees) for m in split] == [repr(m.trees) for m in alone]


def test_tasks_that_hold_the_table_grow_the_trees_of_passes(data, monkeypatch):
    fits = [
        B.Fit(S.BoostParams(trees=12, depth=4, learning_rate=0.3, loss_reduction=0.2, positive_weight=1.7)),
        B.Fit(S.BoostParams(trees=3, depth=2, column_sample=0.5, seed=7, l1=0.5, l2=2.0), "company_id % 3 <> 0"),
        B.Fit(S.BoostParams(trees=40, depth=5, learning_rate=0.8, min_child_weight=0, l2=0.1, **FULL), "company_id % 4 <> 0", "company_id % 4 = 0", 4),
        B.Fit(S.BoostParams(trees=2, depth=1), "company_id < 0"),
        B.Fit(S.BoostParams(trees=0, depth=1)),
    ]
    held = []
    for cores in (2, 20):
        monkeypatch.setattr(type(data.sparkSession.sparkContext), "defaultParallelism", cores)
        held += B.fit_many(data, FEATURES, fits, "company_id")
    monkeypatch.setattr(B, "BLOCK_ROWS", 64)
    monkeypatch.setattr(B, "TASK_ROWS", 100)
    for a, b in zip(held, 2 * B.fit_many(data, FEATURES, fits, "company_id"), strict=True):
        assert (a.params, a.features, a.losses, a.best_round, len(a.trees)) == (b.params, b.features, b.losses, b.best_round, len(b.trees))
        for s, t in zip(a.trees, b.trees):
            assert all(np.array_equal(x, y, equal_nan=True) and x.dtype == y.dtype for x, y in zip(vars(s).values(), vars(t).values()) if isinstance(x, np.ndarray))


def test_no_rows_make_trees_of_one_leaf(data):
    model = B.fit_many(data.where("false"), FEATURES, [B.Fit(S.BoostParams(trees=2, depth=3))], "company_id")[0]
    assert [t.value.tolist() for t in model.trees] == [[0.0], [0.0]]


def test_leaf_of_missing_and_equal_values():
    """Values equal to the cut go left, missing ones right."""
    none = np.zeros(5)
    tree = B.Tree(np.array([0, -1, 1, -1, -1]), np.zeros(5, int), np.array([1.0, np.nan, 2.0, np.nan, np.nan]), np.array([1, -1, 3, -1, -1]), np.array([2, -1, 4, -1, -1]), none, none, none, none)
    x = np.array([[1.0, 9.0], [1.5, 2.0], [np.nan, 2.5], [2.0, np.nan]])
    assert tree.leaf_of(x, tree.threshold).tolist() == [1, 3, 4, 4]
    assert tree.leaf_of(x[:0], tree.threshold).tolist() == []


def test_masked_margins_are_the_sums_of_leaves():
    """Bit for bit, with ties, missing values, single leaves, 64 leaves, several groups, and trees too large for masks."""
    rng = np.random.default_rng(11)

    def tree(inner):
        feature = np.where(np.arange(2 * inner + 1) < inner, rng.integers(0, 3, 2 * inner + 1), -1)
        n, split = np.arange(2 * inner + 1), feature >= 0
        cut = np.where(split, np.round(rng.random(len(n)), 1), np.nan)
        return B.Tree(feature, 0 * n, cut, np.where(split, 2 * n + 1, -1), np.where(split, 2 * n + 2, -1), rng.normal(size=len(n)), n, n, n)

    x = np.round(rng.random((3000, 3)), 1)
    x[::7, 1] = np.nan
    for sizes in ((0, 1, 5, 31, 63) * 41, (70, 3), ()):
        model = B.BoostedTrees(("a", "b", "c"), S.BoostParams(), tuple(tree(i) for i in sizes))
        plain = sum((t.value[t.leaf_of(x, t.threshold)] for t in model.trees), np.zeros(len(x)))
        assert (model.margins(x) == plain).all()
        assert (model.masks is None) == (70 in sizes)
        assert "masks" not in pickle.loads(pickle.dumps(model)).__dict__
