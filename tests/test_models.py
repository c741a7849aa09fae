import json
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline import settings as S
from sieveline.catalog import model_queries
from sieveline.operators import contributions as C
from sieveline.operators import ensembles as E
from sieveline.operators import models as L
from sieveline.operators import splits as P
from sieveline.operators import surrogate as U
from sieveline.operators import tuning as T
from sieveline.operators import validation as V
from sieveline.operators.report import report_json
from sieveline.plans import jobs
from sieveline.plans.star_schema import companies

FEATURES = ("a", "b", "c")
PARAMS = S.BoostParams(trees=4, depth=3, learning_rate=0.3)
PRESETS = {"one": S.BoostParams(2, 2, 0.3), "two": S.BoostParams(2, 3, 0.3), "three": S.BoostParams(3, 2, 0.3)}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x = rng.random((300, 3))
    y = ((x[:, 0] + 0.5 * x[:, 1] + 0.2 * rng.random(300)) > 0.8).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "company_id long, label int, a double, b double, c double")
    return L.training_rows(df, FEATURES, "label", "company_id")


@pytest.fixture(scope="module")
def model(data):
    return L.fit(data, FEATURES, PARAMS)


def test_split_and_folds_depend_on_the_key_only(spark, data):
    one = {r.company_id for r in P.with_split(data, L.KEY).where("is_test").collect()}
    two = {r.company_id for r in P.with_split(data.repartition(5), L.KEY).where("is_test").collect()}
    assert one == two and 0.1 < len(one) / 300 < 0.3
    folds = P.with_folds(data, L.KEY, 5).groupBy("fold").count().collect()
    assert {r.fold for r in folds} == set(range(5)) and sum(r["count"] for r in folds) == 300


def test_exact_split_has_the_quota_of_each_class(many_partitions, data):
    split = P.with_exact_split(data, L.KEY, L.LABEL, 0.25)
    for r in split.groupBy(L.LABEL).agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect():
        assert r.t == round(r.n * 0.25)


def test_scores(data, model):
    scored = L.with_prediction(L.score(model, data)).toPandas()
    assert scored.probability.between(0, 1).all()
    assert (scored.confidence == np.maximum(scored.probability, 1 - scored.probability)).all()
    assert scored.correct.mean() > 0.85
    again = L.score(L.fit(data, FEATURES, PARAMS), data).toPandas()
    assert np.allclose(scored.sort_values("company_id").probability, again.sort_values("company_id").probability)


def test_save_and_load(data, model, tmp_path):
    spark = data.sparkSession
    L.save_model(spark, model, str(tmp_path / "m"))
    both = L.score(L.load_model(spark, str(tmp_path / "m")), L.score(model, data, "before"), "after")
    assert both.where("before <> after").count() == 0


def test_importance(spark, model):
    table = L.importance_table(spark, model, FEATURES).collect()
    assert table[0].feature == "a" and sum(r.importance_pct for r in table) == pytest.approx(100)
    assert len(L.importance_table(spark, model, FEATURES, 2).collect()) == 2


def test_cross_validation_uses_every_row_once(data):
    held_out = L.fold_predictions(data, FEATURES, PARAMS, 3)
    assert held_out.count() == 300 and held_out.select(L.KEY).distinct().count() == 300
    summary = {r.metric: r for r in L.cross_validate(data, FEATURES, PARAMS, 2).collect()}
    assert set(summary) == set(L.CV_METRICS) and summary["accuracy"]["mean"] > 0.75


def test_trained_scorer(data):
    trained = L.train_scorer(data, FEATURES, PARAMS, cv_folds=2)
    got = trained.test_metrics.first()
    assert 0.1 <= trained.threshold <= 0.9 and got.auc > 0.8
    assert trained.params.positive_weight != 1.0
    assert trained.predict(data).count() == 300


def test_early_stopping(spark, data):
    model = L.fit_early_stopping(data, FEATURES, S.BoostParams(trees=40, depth=5, learning_rate=0.8, min_child_weight=0), patience=3)
    losses = L.loss_table(spark, model).toPandas()
    best = losses[losses.is_best].n_trees.item()
    assert len(model.trees) == best and losses.validation_loss[1:].min() == losses.validation_loss[best]
    assert len(losses) - 1 == min(best + 3, 40)


def test_ensembles(data):
    for fitted in (E.fit_voting(data, FEATURES, PRESETS), E.fit_stacking(data, FEATURES, PRESETS, 2)):
        got = fitted.predict(data).toPandas()
        assert len(got) == 300 and got.probability.between(0, 1).all()
    blended = E.fit_blending(data, FEATURES, PRESETS)
    assert sum(blended.weights) == pytest.approx(1.0) and 0 < blended.f1 <= 1
    hard = E.Voting(blended.models, "hard").predict(data).toPandas()
    votes = (hard[["p_one", "p_two", "p_three"]] >= 0.5).sum(axis=1)
    assert ((votes >= 2).astype(int) == hard.prediction).all()


def fitted_by(query, spark, data, monkeypatch):
    """The settings and rows of the first models that a query asks for."""

    class Asked(Exception):
        pass

    def fit_all(df, features, fits):
        raise Asked(fits)

    monkeypatch.setattr(model_queries, "_MADE", {})
    monkeypatch.setattr(model_queries, "rows", lambda *_: data)
    monkeypatch.setattr(L, "fit_all", fit_all)
    with pytest.raises(Asked) as asked:
        query(spark, "own rows")
    return [(f.params, f.where) for f in asked.value.args[0]]


def test_ensemble_comparison_fits_whole_presets(spark, data, monkeypatch):
    got = fitted_by(model_queries.ensemble_comparison, spark, data, monkeypatch)
    parts = ["true", "not is_blend", "fold <> 0", "fold <> 1", "fold <> 2"]
    assert len(got) == 15 and set(got) == {(p, w) for p in S.PRESETS.values() for w in parts}
    assert sorted(p.trees for p in S.PRESETS.values()) == [150, 200, 300]


def test_stacking_ensemble_fits_whole_presets(spark, data, monkeypatch):
    got = fitted_by(model_queries.stacking_ensemble, spark, data, monkeypatch)
    parts = ["true", *(f"fold <> {i}" for i in range(5))]
    assert len(got) == 18 and set(got) == {(p, w) for p in S.PRESETS.values() for w in parts}


def test_comparison_is_of_the_ensembles_fitted_alone(data):
    split = P.with_exact_split(data, L.KEY, L.LABEL, 0.3)
    train, test = split.where("not is_test").drop("is_test"), split.where("is_test")
    got = {r.method: r for r in E.compare(train, test, FEATURES, PRESETS, 3).collect()}
    alone = {"voting": E.fit_voting(train, FEATURES, PRESETS), "stacking": E.fit_stacking(train, FEATURES, PRESETS, 3), "blending": E.fit_blending(train, FEATURES, PRESETS)}
    assert set(got) == set(alone)
    for name, fitted in alone.items():
        made = fitted.predict(test).toPandas()
        assert got[name].accuracy == pytest.approx((made.prediction == made.label).mean())
    assert sum(r.is_best for r in got.values()) == 1


def test_stacking_weights_are_the_penalised_optimum(data):
    fitted = E.fit_stacking(data, FEATURES, PRESETS, 2, c=0.5)
    held = fitted.held_out.toPandas()
    x = held[E.probability_columns(PRESETS)].to_numpy()
    meta = fitted.meta.stages[-1]
    w = meta.coefficients.toArray()
    gap = 1 / (1 + np.exp(-(x @ w + meta.intercept))) - held.label
    assert np.allclose(x.T @ gap + w / 0.5, 0, atol=1e-2) and abs(gap.sum()) < 1e-2


def test_search_keeps_the_first_best(data):
    found = T.grid_search(data, FEATURES, PARAMS, {"depth": (1, 2), "trees": (1, 2)}, k=2)
    assert len(found.tried) == 4 and found.best_score == max(found.scores)
    assert found.best == found.tried[found.scores.index(found.best_score)]
    history = T.history(data, [found])
    assert history.where("is_best").count() == 1
    drawn = T.random_search(data, FEATURES, PARAMS, {"depth": (1, 2, 3)}, draws=2, k=2)
    assert len(set(drawn.tried)) == 2 and all(c.trees == PARAMS.trees for c in drawn.tried)
    assert len(T.combinations(S.TuningGrids().tree)) == 80


def test_weighted_f1(spark):
    counts = spark.createDataFrame([(0, 1, 1, 6), (0, 1, 0, 2), (0, 0, 1, 1), (0, 0, 0, 3), (1, 0, 0, 4)], "c int, label int, prediction int, n long")
    got = {r.c: r.weighted_f1 for r in T.weighted_f1(counts, ["c"]).collect()}
    assert got[0] == pytest.approx((8 * 12 / 15 + 4 * 6 / 9) / 12) and got[1] == 1.0


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_calibration(data, method):
    got = V.calibrate(data, FEATURES, PARAMS, method, 2).predict(data).toPandas()
    assert got.probability.between(0, 1).all() and len(got) == 300
    assert abs(got.probability.mean() - got.label.mean()) < 0.1


def test_isotonic_is_the_largest_of_least_means(many_partitions, data):
    rng = np.random.default_rng(4)
    x = np.round(rng.random(400), 2)
    y = (rng.random(400) < 0.3 + 0.4 * x).astype(int)
    rows = many_partitions.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, label int")
    made = V.isotonic(rows, "x")
    values = np.unique(x)
    n, t = np.array([(x == v).sum() for v in values]), np.array([y[x == v].sum() for v in values])
    mean = lambda a, b: t[a : b + 1].sum() / n[a : b + 1].sum()
    want = {v: max(min(mean(a, b) for b in range(i, len(values))) for a in range(i + 1)) for i, v in enumerate(values)}
    got = made.apply(rows, "x", "y").collect()
    assert len(got) == 400 and all(r.y == pytest.approx(want[r.x]) for r in got)
    blocks = made.blocks.orderBy("low").collect()
    assert len(blocks) > 2 and all(a.value < b.value and a.high < b.low for a, b in zip(blocks, blocks[1:]))
    between = (blocks[0].high + blocks[1].low) / 2
    asked = many_partitions.createDataFrame([(-5.0,), (between,), (7.0,), (None,)], "x double")
    low, mid, high = (r.y for r in made.apply(asked, "x", "y").where("x is not null").orderBy("x").collect())
    assert low == blocks[0].value and high == blocks[-1].value and mid == pytest.approx((blocks[0].value + blocks[1].value) / 2)


def test_sigmoid_meets_smoothed_targets(spark):
    rows = spark.createDataFrame([(0.1, 0)] * 5 + [(0.9, 1)] * 3 + [(0.5, 1), (0.5, 0)], "x double, label int")
    made = V.sigmoid(rows, "x")
    target = {1: 5 / 6, 0: 1 / 8}
    gap = [1 / (1 + np.exp(-(made.slope * r.x + made.intercept))) - target[r.label] for r in rows.collect()]
    assert abs(sum(gap)) < 1e-5 and abs(sum(g * r.x for g, r in zip(gap, rows.collect()))) < 1e-5


def test_nested_and_learning_curve(data):
    nested = V.nested_cross_validation(data, FEATURES, PARAMS, {"depth": (1, 2)}, 2, 2).first()
    assert nested.auc > 0.7 and nested.cv_std >= 0
    curve = V.learning_curve(data, FEATURES, PARAMS, (0.3, 1.0), 2).collect()
    assert {r.share for r in curve} == {0.3, 1.0} and all(0 <= r.validation_f1 <= 1 for r in curve)


def expected_margin(made, x, known):
    """The path-dependent expectation when only ``known`` features are known."""
    total = 0.0
    for b in made:
        for leaf in range(len(b.value)):
            part = b.value[leaf]
            for f, low, high, share in zip(b.feature[leaf], b.low[leaf], b.high[leaf], b.share[leaf]):
                if f >= 0:
                    part *= float(low < x[f] <= high) if f in known else share
            total += part
    return total


def brute_contributions(made, x, d):
    out = np.zeros(d)
    for i in range(d):
        others = [j for j in range(d) if j != i]
        for size in range(d):
            weight = factorial(size) * factorial(d - size - 1) / factorial(d)
            for known in combinations(others, size):
                out[i] += weight * (expected_margin(made, x, {*known, i}) - expected_margin(made, x, set(known)))
    return out


def test_contributions_by_all_subsets(data, model):
    made = C.tree_boxes(model)
    rng = np.random.default_rng(2)
    x = rng.random(size=(25, 3))
    got = C.contributions_of(x, made)
    for row, want in zip(got, x):
        assert np.allclose(row, brute_contributions(made, want, 3))


def test_contributions_add_up_to_the_margin(data, model):
    rows = C.row_contributions(model, data, FEATURES)
    long = C.feature_contributions(rows)
    assert long.count() == 900
    base = C.base_value(C.tree_boxes(model))
    sums = long.groupBy(L.KEY).agg(F.sum("contribution").alias("s"))
    p = L.score(model, data).join(sums, L.KEY).toPandas()
    assert np.allclose(1 / (1 + np.exp(-(p.s + base))), p.probability)
    top = C.top_contributions(rows, top=2).toPandas()
    assert len(top) == 600 and set(top["rank"]) == {1, 2}
    both = top.pivot(index="company_id", columns="rank", values="contribution").abs()
    assert (both[1] >= both[2]).all()
    assert C.global_contributions(long).agg(F.sum("importance_pct")).first()[0] == pytest.approx(100)


def test_surrogate_is_the_weighted_ridge_fit(data, model):
    small = data.where("company_id < 4")
    got = U.local_surrogate(model, small, FEATURES, samples=50, top=3, reference=data).toPandas()
    bins = U.fit_bins(data, FEATURES)
    salts = small.select("company_id", F.xxhash64(F.col("company_id").cast("string"), F.lit(42)).alias("s"), *FEATURES).collect()
    for r in salts:
        x = np.array([r[f] for f in FEATURES])
        flags, values = U.copies(x, r.s, bins, 50)
        assert (values[0] == x).all() and (flags[0] == 1).all()
        own = [np.searchsorted(c, v) for c, v in zip(bins.cuts, x)]
        assert (flags == np.stack([[np.searchsorted(c, v) == o for c, v, o in zip(bins.cuts, row, own)] for row in values])).all()
        w = np.sqrt(np.exp(-((1 - flags) ** 2).sum(axis=1) / (0.75 * np.sqrt(3)) ** 2))[:, None]
        p = 1 / (1 + np.exp(-model.margins(values)))
        z = np.c_[flags, np.ones(50)]
        want = np.linalg.solve(z.T @ (w * z) + np.diag([1, 1, 1, 0]), (z * w).T @ p)
        mine = got[got.company_id == r.company_id].set_index("feature").weight
        assert np.allclose([mine[f] for f in FEATURES], want[:3])
        assert np.allclose(got[got.company_id == r.company_id].intercept, want[3])
    assert U.local_surrogate(model, small, FEATURES, samples=20, top=1).count() == 4


def test_surrogate_draws_follow_the_bins(data):
    bins = U.fit_bins(data, FEATURES)
    x = np.array([0.5, 0.5, 0.5])
    _, values = U.copies(x, 11, bins, 20_000)
    for j, f in enumerate(FEATURES):
        column = np.array([r[0] for r in data.select(f).collect()])
        counts = np.bincount(np.searchsorted(bins.cuts[j], values[:, j]), minlength=4) / 20_000
        assert np.allclose(counts, np.bincount(np.searchsorted(bins.cuts[j], column)) / len(column), atol=0.02)
        assert values[:, j].min() >= column.min() and values[:, j].max() <= column.max()


def test_report_document(spark):
    small = spark.createDataFrame([(1, None)], "x int, y double")
    text = report_json(spark, {"one": small}).first().document
    assert text == '{"one":[{"x":1,"y":null}]}'


def test_training_and_explaining_as_jobs(spark, data):
    labels = data.selectExpr("cast(company_id as string) symbol", "label AS shariah_compliant")
    features = data.selectExpr("cast(company_id as string) symbol", *FEATURES)
    trained = jobs.train_and_evaluate(labels, features, PARAMS, cv_folds=2)
    assert trained.features == FEATURES and trained.test_metrics.first().accuracy > 0.7
    predictions, reasons, importance = jobs.explain_predictions(trained.model, data, FEATURES, L.KEY, top=2)
    assert predictions.count() == 300 and reasons.count() == 600 and importance.count() == 3
    row = predictions.first()
    assert row.compliance_probability + row.non_compliance_probability == pytest.approx(1.0)
    text = jobs.technical_report(trained.model, PARAMS, data, FEATURES, L.KEY).first().document
    report = json.loads(text)
    assert report["data"][0]["n_rows"] == 300 and len(report["feature_importance"]) == 3


def test_portfolio_scoring_needs_its_features(data, model):
    made = jobs.score_portfolio(data, model, FEATURES, [L.KEY]).toPandas()
    assert set(made.decision) == {"PERMIT", "REJECT"}
    assert ((made.permit_probability >= 0.5) == (made.decision == "PERMIT")).all()
    with pytest.raises(ValueError, match="lacks the columns c"):
        jobs.score_portfolio(data.drop("c"), model, FEATURES, [L.KEY])


def test_hybrid_screen_scores_edges_only(spark, sf_dir):
    portfolio = companies(spark, sf_dir).withColumnRenamed("symbol", "ticker").drop("company_id")
    rows = model_queries.rows(spark, sf_dir)
    model = L.fit(rows, S.MODEL_FEATURES, S.BoostParams(trees=2, depth=2))
    got = jobs.hybrid_screen(portfolio, model, [("roa", 0.5)]).toPandas()
    assert len(got) == portfolio.count()
    edges = got.status == "EDGE_CASE"
    assert edges.any() and got[edges].ml_score.notna().all() and got[~edges].ml_score.isna().all()
    assert np.allclose(got[edges].final_confidence, 0.5 + 0.5 * got[edges].ml_score)
