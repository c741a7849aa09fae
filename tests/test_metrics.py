import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveline.operators import metrics as M
from sieveline.operators import summaries as A
from sieveline.operators import thresholds as T
from sieveline.operators.ranking import (
    equal_width_histogram,
    exact_quantiles,
    running_counts,
    with_percent_rank,
)

SCORED = "id long, label int, prediction int, probability double, confidence double"


def make(spark, pairs):
    rows = [(i, y, int(p >= 0.5), float(p), max(p, 1.0 - p)) for i, (y, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, SCORED)


@pytest.fixture
def sample(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(400), 2)
    p[:140] = 0.5  # a third of all rows share one score
    y = (rng.random(400) < p).astype(int)
    return make(spark, list(zip(y.tolist(), p.tolist()))), y, p


def test_published_confusion_counts(spark):
    counts = spark.createDataFrame([(76, 16, 6, 2)], "tp long, tn long, fp long, fn long")
    hard = M.hard_metrics(counts).first()
    assert hard.accuracy == pytest.approx(0.92)
    assert hard.precision == pytest.approx(0.926829268292683)
    assert hard.recall == pytest.approx(0.9743589743589743)
    assert hard.f1 == pytest.approx(0.95)
    assert hard.matthews_corr == pytest.approx(0.7565274077488416)
    assert hard.cohens_kappa == pytest.approx(0.7506234413965087)
    both = M.confusion_metrics(counts).first()
    assert both.specificity == pytest.approx(0.7272727272727273)
    assert both.fnr == pytest.approx(0.02564102564102564)
    cost = M.business_cost(counts).first()
    assert (cost.total_cost, cost.cost_per_sample) == (16.0, 0.16)


def test_error_summary_rates_are_over_all_rows(spark):
    pairs = [(1, 0.9)] * 76 + [(0, 0.1)] * 16 + [(0, 0.7)] * 6 + [(1, 0.3)] * 2
    df = make(spark, pairs)
    got = M.error_summary(df).first()
    assert (got.total_errors, got.false_positives, got.false_negatives) == (8, 6, 2)
    assert got.error_rate == pytest.approx(0.08) and got.false_negative_rate == pytest.approx(0.02)
    assert got.min_error_confidence == 0.3 and got.max_error_confidence == 0.7
    kinds = [r.error for r in M.error_rows(df, "id").collect()]
    assert kinds.count("false_positive") == 6 and kinds.count("false_negative") == 2


def test_zero_denominators(spark):
    df = make(spark, [(0, 0.1), (0, 0.2)])
    hard = M.hard_metrics(M.confusion(df)).first()
    assert hard.precision == hard.recall == hard.f1 == hard.matthews_corr == 0.0
    assert M.auc(df).first().auc is None
    assert M.class_weight(df).first().scale_pos_weight == 1.0


def test_class_weight(spark):
    df = spark.createDataFrame([(1,)] * 386 + [(0,)] * 110, "label int")
    assert M.class_weight(df).first().scale_pos_weight == pytest.approx(0.2849740932642487)


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def test_auc_by_pairs(many_partitions, sample):
    df, y, p = sample
    assert M.auc(df).first().auc == pytest.approx(brute_auc(y, p))
    halves = df.withColumn("half", F.col("id") % 2)
    got = {r.half: r.auc for r in M.auc(halves, by=["half"]).collect()}
    for h in (0, 1):
        keep = np.arange(len(y)) % 2 == h
        assert got[h] == pytest.approx(brute_auc(y[keep], p[keep]))


def test_curves_by_thresholds(many_partitions, sample):
    df, y, p = sample
    want = []
    for t in np.unique(p)[::-1]:
        hit = p >= t
        want.append((t, (hit & (y == 0)).sum() / (y == 0).sum(), (hit & (y == 1)).sum() / (y == 1).sum()))
    full = M.roc_curve(df, drop_collinear=False).toPandas().sort_values("threshold", ascending=False)
    assert math.isinf(full.threshold.iloc[0]) and len(full) == len(want) + 1
    assert np.allclose(full.iloc[1:].to_numpy(), np.array(want))
    # leaving out collinear points keeps the area and every corner
    fps = np.array([w[1] * (y == 0).sum() for w in want]).round()
    tps = np.array([w[2] * (y == 1).sum() for w in want]).round()
    keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True]
    short = M.roc_curve(df).toPandas().sort_values("threshold", ascending=False)
    assert np.allclose(short.iloc[1:].to_numpy(), np.array(want)[keep])
    pr = M.pr_curve(df).toPandas()
    assert len(pr) == len(want) + 1
    last = pr[pr.threshold.isna()].iloc[0]
    assert (last.precision, last.recall) == (1.0, 0.0)


def test_running_counts_over_partitions(many_partitions, sample):
    df, _, p = sample
    got = running_counts(df, "probability").toPandas()
    assert got["_part"].nunique() > 1
    for row in got.itertuples():
        assert row.n == (p == row.probability).sum()
        assert row.n_before == (p < row.probability).sum()
        assert row.n_total == len(p)


def test_percent_rank_with_hot_values_and_nulls(many_partitions):
    spark = many_partitions
    values = [1.0] * 900 + [float(i) for i in range(2, 1500)] + [None] * 5
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    got = with_percent_rank(df, "v", "r").toPandas().sort_values("id")
    want = pd.Series(values, dtype=float).rank(pct=True)
    assert len(got) == len(values)
    assert np.allclose(got.r.to_numpy(dtype=float), want.to_numpy(), equal_nan=True)


def test_exact_quantiles(many_partitions):
    spark = many_partitions
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=501), np.round(rng.random(501), 1)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    got = {(r.feature, r.share): r["quantile"] for r in exact_quantiles(df, ["a", "b"], [0.0, 0.25, 0.333, 1.0]).collect()}
    for name, values in (("a", a), ("b", b)):
        for share in (0.0, 0.25, 0.333, 1.0):
            assert got[(name, share)] == pytest.approx(np.quantile(values, share))


@pytest.mark.parametrize("accuracy", [50, 200])
def test_bracketed_quantiles_are_exact(many_partitions, accuracy):
    spark = many_partitions
    rng = np.random.default_rng(8)
    a = rng.normal(size=3000)
    b = np.where(np.arange(3000) % 3 == 0, 0.5, rng.random(3000))
    shares = [0.0, 0.25, 0.5, 0.77, 1.0]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    found = exact_quantiles(df, ["a", "b"], shares, accuracy)
    got = {(r.feature, r.share): r["quantile"] for r in found.collect()}
    assert len(got) == 10
    for name, values in (("a", a), ("b", b)):
        for share in shares:
            assert got[(name, share)] == pytest.approx(np.quantile(values, share))


def test_describe_matches_pandas(spark):
    values = [1.0, 2.0, 2.0, 7.5, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = A.describe(df, ["x"]).first()
    want = pd.Series(values).describe()
    assert [got.n, got["mean"], got["std"], got["min"], got.q25, got.q50, got.q75, got["max"]] == pytest.approx(want.tolist())
    assert A.describe(df, ["x"], approximate=True).first().n == 4


def test_histogram_bins(spark):
    values = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r.bin: r.n for r in equal_width_histogram(df, "x", 4).collect()}
    assert got == {i: int(n) for i, n in enumerate(np.histogram(values, 4)[0]) if n}
    flat = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert equal_width_histogram(flat, "x", 4).collect()[0].n == 2


def test_bands_on_their_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.5, 0.6, 0.9, 1.0)], "confidence double")
    left = {r.band: r.n for r in A.confidence_histogram(df).collect()}
    right = {r.band: r.n for r in A.confidence_histogram(df, right_closed=True).collect()}
    assert left == {"50-60%": 1, "60-70%": 1, "70-80%": 0, "80-90%": 0, "90-100%": 2}
    assert right == {"50-60%": 1, "60-70%": 0, "70-80%": 0, "80-90%": 1, "90-100%": 1}


def test_calibration_bins_are_right_closed(spark):
    df = make(spark, [(0, 0.0), (1, 0.1), (1, 0.100001), (0, 1.0)])
    curve = {r.bin: (r.n, r.prob_true) for r in M.calibration_curve(df).collect()}
    assert curve == {0: (2, 0.5), 1: (1, 1.0), 9: (1, 0.0)}
    plain = M.calibration_error(M.calibration_curve(df)).first().ece
    assert plain == pytest.approx(np.mean([abs(0.05 - 0.5), abs(0.100001 - 1), 1.0]))


def test_log_loss_is_finite_at_the_ends(spark):
    got = M.probability_losses(make(spark, [(1, 0.0), (0, 0.0)])).first()
    assert math.isfinite(got.log_loss) and got.brier_score == 0.5


def test_threshold_grid_by_counting(spark, sample):
    df, y, p = sample
    for r in T.threshold_counts(df).collect():
        hit = p >= r.threshold
        assert (r.tp, r.fp) == ((hit & (y == 1)).sum(), (hit & (y == 0)).sum())
        assert (r.fn, r.tn) == ((~hit & (y == 1)).sum(), (~hit & (y == 0)).sum())
    assert T.threshold_counts(df).count() == 17


def test_lowest_threshold_wins_ties(spark):
    df = make(spark, [(1, 0.9), (0, 0.05)])
    assert T.best_threshold(T.threshold_metrics(df)).first().threshold == 0.1


def test_blend_grid_and_default(spark):
    grid = T.blend_grid()
    assert len(grid) == 55 and all(abs(sum(w) - 1) < 1e-9 and w[2] > 0 for w in grid)
    df = spark.createDataFrame([(1, 0.1, 0.1, 0.1)], "label int, p1 double, p2 double, p3 double")
    best = T.best_blend(T.blend_scores(df, ["p1", "p2", "p3"])).first()
    assert best.w1 == best.w2 == best.w3 == pytest.approx(1 / 3) and best.f1 == 0.0


def test_votes(spark):
    df = spark.createDataFrame([(0.9, 0.4, 0.3), (0.5, 0.5, 0.1)], "a double, b double, c double")
    names = ["a", "b", "c"]
    got = df.select(T.soft_vote(names).alias("s"), T.hard_vote(names).alias("h")).collect()
    assert got[0].s == pytest.approx(1.6 / 3) and [r.h for r in got] == [0, 1]


def test_class_report(spark):
    counts = spark.createDataFrame([(76, 16, 6, 2)], "tp long, tn long, fp long, fn long")
    got = {r["class"]: r for r in M.class_report(counts).collect()}
    assert got["1"].f1 == 0.95 and got["0"].support == 22 and got["1"].support == 78
    assert got["0"].precision == pytest.approx(0.8889) and got["weighted avg"].recall == 0.92


def test_fold_summary_uses_population_spread(spark):
    df = spark.createDataFrame([(0, 0.8), (1, 0.9)], "fold int, f1 double")
    got = M.fold_summary(df, ["f1"]).first()
    assert got["mean"] == pytest.approx(0.85) and got["std"] == pytest.approx(0.05) and got.n_folds == 2


def test_evaluation_bundle(spark, sample):
    df, y, p = sample
    got = M.evaluation(df).first()
    assert got.ranking.auc == pytest.approx(brute_auc(y, p))
    assert got.classification.accuracy == pytest.approx(((p >= 0.5) == y).mean())
    assert got.business_metrics.cost_fn == 5.0


def test_top_lists(spark):
    rows = [(f"s{i:02d}", i % 2, 0.5 + i / 100) for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, predicted_compliant int, confidence double")
    best = [r.symbol for r in A.most_confident(df, 3).collect()]
    low = A.least_confident_rejections(df, 2).collect()
    assert best == ["s39", "s37", "s35"]
    assert [r.symbol for r in low] == ["s00", "s02"] and low[0].risk_score == 0.5
    assert A.extreme_probabilities(df.withColumnRenamed("confidence", "probability"), 5).count() == 10
