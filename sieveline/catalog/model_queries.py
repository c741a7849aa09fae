"""Queries that train models on the test tables.

A trained model has no SQL form, so what SQL can recompute from staged rows and scores is checked by itself:
the first split, leaf values, losses per round, folds, the stacked logistic, calibrators on given scores.
Queries of one folder share their staged rows and fitted models.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline import settings as S
from sieveline.catalog.base import (
    LABEL_RULES,
    SCREENING_RULES,
    SQL_FEATURES,
    SQL_LABELS,
    SQL_SCORED,
    labels,
    query,
    scored,
    with_sql,
)
from sieveline.catalog.metric_queries import UNIT
from sieveline.operators import boosting as B
from sieveline.operators import contributions as C
from sieveline.operators import ensembles as E
from sieveline.operators import metrics as M
from sieveline.operators import models as L
from sieveline.operators import report as R
from sieveline.operators import summaries as A
from sieveline.operators import tuning as T
from sieveline.operators import validation as V
from sieveline.operators.features import feature_table
from sieveline.operators.labeling import label_companies
from sieveline.operators.screening import flat_decisions
from sieveline.operators.splits import with_exact_split, with_stratified_folds
from sieveline.operators.surrogate import bin_statistics, local_surrogate, quartile_cuts
from sieveline.plans.jobs import hybrid_screen, technical_report
from sieveline.plans.star_schema import companies
from sieveline.sources.staging import stage, staged_path

FEATURES = S.MODEL_FEATURES
MODEL = S.BoostParams()
FOLDS = 5
#: Fewer trees than the settings have, at a rate raised alike; the README names the queries and what the whole would take.
FEWER = 10


def fewer(params: S.BoostParams) -> S.BoostParams:
    return replace(params, trees=params.trees // FEWER, learning_rate=min(params.learning_rate * FEWER, 0.3))


WEIGHTED, NESTED, LEARNING, SEARCHED = fewer(S.SCORER_MODEL), fewer(MODEL), fewer(MODEL), fewer(MODEL)
PRESETS = {n: fewer(p) for n, p in S.PRESETS.items()}

_MADE: dict[tuple, object] = {}


def once(spark, sf_dir, name, make):
    """What several queries of a session share: staged rows and models of one folder."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _MADE:
        _MADE[at] = make()
    return _MADE[at]


def rows(spark, sf_dir) -> DataFrame:
    """Staged training rows: key, label, the 19 features and stratified folds."""

    def make():
        data = feature_table(companies(spark, sf_dir))
        labelled = label_companies(data, LABEL_RULES, keep=FEATURES).withColumn(L.KEY, F.col("symbol").cast("long"))
        return L.training_rows(labelled, FEATURES, "shariah_compliant", L.KEY)

    return once(spark, sf_dir, "rows", make)


def base_model(spark, sf_dir) -> B.BoostedTrees:
    return once(spark, sf_dir, "model", lambda: L.fit(rows(spark, sf_dir), FEATURES, MODEL))


def held_out(spark, sf_dir) -> tuple[list[B.BoostedTrees], DataFrame]:
    """The fold models and every row's score by the one that did not see it."""

    def make():
        folded = stage(with_stratified_folds(rows(spark, sf_dir), L.KEY, L.LABEL, FOLDS), "folds")
        models = L.fit_all(folded, FEATURES, [B.Fit(MODEL, f"fold <> {i}") for i in range(FOLDS)])
        own = F.get(B.probability_column(models), F.col("fold"))
        return models, stage(folded.withColumn("probability", own), "held-out")

    return once(spark, sf_dir, "held-out", make)


# --- the trees themselves ------------------------------------------------------------

#: Features in steps of a hundredth between -1 and 1, so that SQL can try every split.
SQL_STEPS = SQL_LABELS + """,
steps AS (SELECT company_id, shariah_compliant AS label, """ + ", ".join(
    f"round(greatest(-1.0, least(1.0, {c})), 2) AS {c}" for c in ("debt_to_assets", "f_nonhalal", "riba_intensity", "roa", "profit_margin")
) + " FROM labels)"
STEP_FEATURES = ("debt_to_assets", "f_nonhalal", "riba_intensity", "roa", "profit_margin")
ONE_SPLIT = S.BoostParams(trees=1, depth=1, learning_rate=0.3, row_sample=1.0, column_sample=1.0, positive_weight=1.5, l1=0.5, l2=2.0)


def _sql_root_split() -> str:
    p = ONE_SPLIT
    pull = lambda g: f"sign({g}) * greatest(abs({g}) - {p.l1}, 0)"
    gain = lambda g, h: f"pow({pull(g)}, 2) / ({h} + {p.l2})"
    value = lambda g, h: f"round(-{p.learning_rate} * {pull(g)} / ({h} + {p.l2}), 6)"
    long = "\nUNION ALL\n".join(f"SELECT {i} AS nr, '{f}' AS feature, {f} AS x, g, h FROM w" for i, f in enumerate(STEP_FEATURES))
    return with_sql(
        SQL_STEPS,
        f""", w AS (SELECT *, CASE WHEN label = 1 THEN {p.positive_weight} ELSE 1 END * (0.5 - label) AS g,
  CASE WHEN label = 1 THEN {p.positive_weight} ELSE 1 END * 0.25 AS h FROM steps),
cells AS (SELECT nr, feature, x, sum(g) AS g, sum(h) AS h FROM ({long}) GROUP BY ALL),
sums AS (SELECT *, sum(g) OVER v AS gl, sum(h) OVER v AS hl, sum(g) OVER f AS gt, sum(h) OVER f AS ht, max(x) OVER f AS top FROM cells
  WINDOW v AS (PARTITION BY nr ORDER BY x), f AS (PARTITION BY nr)),
gains AS (SELECT *, {gain('gl', 'hl')} + {gain('(gt - gl)', '(ht - hl)')} - {gain('gt', 'ht')} AS gain FROM sums
  WHERE x < top AND hl >= {p.min_child_weight} AND ht - hl >= {p.min_child_weight}),
best AS (SELECT * FROM gains ORDER BY round(gain, 6) DESC, nr, x LIMIT 1)
SELECT feature, x AS threshold, round(gain, 4) AS gain, {value('gl', 'hl')} AS left_value, {value('(gt - gl)', '(ht - hl)')} AS right_value FROM best""",
    ).replace("\n, w AS", ",\nw AS")


@query("boosted_root_split", _sql_root_split())
def boosted_root_split(spark, sf_dir):
    """One tree of depth one with L1, L2 and class weight: its split, gain and leaves."""
    step = {f: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(f))), 2) for f in STEP_FEATURES}
    model = L.fit(stage(rows(spark, sf_dir).withColumns(step), "steps"), STEP_FEATURES, ONE_SPLIT)
    nodes = B.node_table(spark, model)
    value = lambda n: F.max(F.when(F.col("node") == n, F.round("value", 6)))
    return nodes.agg(
        F.max("feature").alias("feature"), F.max("threshold").alias("threshold"), F.round(F.max("gain"), 4).alias("gain"),
        value(1).alias("left_value"), value(2).alias("right_value"),
    )


@query(
    "boosted_leaf_values",
    with_sql(
        SQL_LABELS,
        "SELECT t AS tree, count(*) AS n_rows, 0 AS n_wrong_leaves FROM labels, (SELECT unnest([0, 1, 9]) AS t) GROUP BY t",
    ),
)
def boosted_leaf_values(spark, sf_dir):
    """Leaf values of three trees against -G / (H + lambda) summed again from the rows that reach the leaf."""
    params = replace(MODEL, trees=10, row_sample=1.0)
    data = rows(spark, sf_dir)
    model = once(spark, sf_dir, "ten-trees", lambda: L.fit(data, FEATURES, params))
    out = []
    for t in (0, 1, 9):
        before = replace(model, trees=model.trees[:t])
        leaf = B.leaf_column(model, t)
        at = stage(L.score(before, data, "p").withColumn("node", leaf), "leaves")
        sums = at.groupBy("node").agg(F.sum(F.col("p") - F.col(L.LABEL)).alias("g"), F.sum(F.col("p") * (1 - F.col("p"))).alias("h"), F.count("*").alias("n"))
        nodes = B.node_table(spark, model).where((F.col("tree") == t) & F.col("feature").isNull())
        both = nodes.join(sums, "node", "full")
        wrong = F.abs(-F.lit(params.learning_rate) * F.col("g") / (F.col("h") + F.lit(params.l2)) - F.col("value")) > 1e-5
        out.append(both.agg(F.sum("n").alias("n_rows"), F.count_if(F.coalesce(wrong, F.lit(True))).cast("int").alias("n_wrong_leaves")).withColumn("tree", F.lit(t)))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("boosted_tree_scores")
def boosted_tree_scores(spark, sf_dir):
    predicted = L.with_prediction(L.score(base_model(spark, sf_dir), rows(spark, sf_dir)))
    return predicted.select(L.KEY, L.LABEL, "probability", "prediction", "confidence", "correct")


@query(
    "boosted_tree_consistency",
    "SELECT c_custkey AS company_id, 1 AS class_follows, 1 AS confident, 1 AS learned FROM customer",
)
def boosted_tree_consistency(spark, sf_dir):
    """The class and confidence follow the probability; the model beats a constant on its training rows."""
    made = boosted_tree_scores(spark, sf_dir)
    p = F.col("probability")
    loss = -F.ln(F.when(F.col(L.LABEL) == 1, p).otherwise(1 - p))
    learned = made.agg((F.avg(loss) < F.lit(0.35)).cast("int")).scalar()
    return made.select(
        L.KEY,
        ((p >= 0.5).cast("int") == F.col("prediction")).cast("int").alias("class_follows"),
        (F.col("confidence") == F.greatest(p, 1 - p)).cast("int").alias("confident"),
    ).withColumn("learned", learned)


@query("weighted_scorer")
def weighted_scorer(spark, sf_dir):
    trained = once(spark, sf_dir, "scorer", lambda: L.train_scorer(rows(spark, sf_dir), FEATURES, WEIGHTED))
    cv = trained.cv_f1
    return trained.test_metrics.withColumns(
        {
            "threshold": F.lit(trained.threshold),
            "positive_weight": F.lit(trained.params.positive_weight),
            "cv_mean": cv.select("mean").scalar(),
            "cv_std": cv.select("std").scalar(),
        }
    )


def _stopped(spark, sf_dir) -> B.BoostedTrees:
    return once(spark, sf_dir, "early-stopping", lambda: L.fit_early_stopping(rows(spark, sf_dir), FEATURES, S.EARLY_STOP_MODEL))


@query("early_stopping_scores")
def early_stopping_scores(spark, sf_dir):
    model = _stopped(spark, sf_dir)
    made = L.with_prediction(L.score(model, rows(spark, sf_dir)))
    return made.select(L.KEY, "probability", "prediction").withColumn("n_trees", F.lit(len(model.trees)))


@query(
    "early_stopping_rounds",
    "SELECT 1 AS loss_recomputed, 1 AS best_is_least, 1 AS first_of_equals, 1 AS patience_kept, 1 AS trees_kept",
)
def early_stopping_rounds(spark, sf_dir):
    """The best round again from the staged losses of all rounds, and its loss from the scores of its model."""
    model = _stopped(spark, sf_dir)
    losses = stage(L.loss_table(spark, model).where("n_trees > 0"), "losses")
    data = with_exact_split(rows(spark, sf_dir), L.KEY, L.LABEL, 0.2, 42, "is_validation").where("is_validation")
    p = F.col("probability")
    again = L.score(model, data).agg(F.avg(-F.ln(F.when(F.col(L.LABEL) == 1, p).otherwise(1 - p)))).scalar()
    best = losses.agg(F.min_by("n_trees", F.struct("validation_loss", "n_trees"))).scalar()
    chosen = losses.where("is_best")
    waited = (F.max("n_trees") == F.least(F.first("best") + L.PATIENCE, F.lit(S.EARLY_STOP_MODEL.trees))).cast("int")
    return (
        losses.withColumn("best", best)
        .agg(
            (F.abs(F.max(F.when(F.col("is_best"), F.col("validation_loss"))) - again) < 1e-6).cast("int").alias("loss_recomputed"),
            (F.min("validation_loss") == chosen.select("validation_loss").scalar()).cast("int").alias("best_is_least"),
            (F.first("best") == chosen.select("n_trees").scalar()).cast("int").alias("first_of_equals"),
            waited.alias("patience_kept"),
            (F.first("best") == F.lit(len(model.trees))).cast("int").alias("trees_kept"),
        )
    )


@query("cross_validation")
def cross_validation(spark, sf_dir):
    return M.fold_summary(L.fold_metrics(held_out(spark, sf_dir)[1]), L.CV_METRICS)


@query(
    "cross_validation_pooled",
    "SELECT 5 AS n_folds, count(*) AS n_rows, 1 AS accuracy_agrees, 1 AS better_than_majority FROM customer",
)
def cross_validation_pooled(spark, sf_dir):
    """Accuracy per fold again from the staged scores, weighted to the whole."""
    made = held_out(spark, sf_dir)[1]
    right = ((F.col("probability") >= 0.5).cast("int") == F.col(L.LABEL)).cast("double")
    folds = made.groupBy("fold").agg(F.avg(right).alias("a"), F.count("*").alias("n"))
    mean = M.fold_summary(L.fold_metrics(made), ("accuracy",)).select("mean").scalar()
    majority = made.agg(F.greatest(F.avg(L.LABEL), 1 - F.avg(L.LABEL))).scalar()
    return folds.agg(
        F.count("*").cast("int").alias("n_folds"),
        F.sum("n").alias("n_rows"),
        (F.abs(F.avg("a") - mean) < 1e-9).cast("int").alias("accuracy_agrees"),
        (F.sum(F.col("a") * F.col("n")) / F.sum("n") > majority).cast("int").alias("better_than_majority"),
    )


@query("feature_importance")
def feature_importance(spark, sf_dir):
    return L.importance_table(spark, base_model(spark, sf_dir), FEATURES, top=15)


@query("importance_from_nodes", "SELECT CAST(0 AS BIGINT) AS n_wrong, CAST(1 AS BIGINT) AS n_sums")
def importance_from_nodes(spark, sf_dir):
    """Importances again as mean gains over the node table, and their sum."""
    model = base_model(spark, sf_dir)
    means = B.node_table(spark, model).where("feature is not null").groupBy("feature").agg(F.avg("gain").alias("mean"))
    again = means.withColumn("share", F.col("mean") / means.agg(F.sum("mean")).scalar())
    both = L.importance_table(spark, model, FEATURES).join(again, "feature", "left")
    wrong = F.abs(F.col("importance") - F.coalesce("share", F.lit(0.0))) > 1e-9
    return both.agg(F.count_if(wrong).alias("n_wrong"), F.round(F.sum("importance"), 9).cast("long").alias("n_sums"))


@query("model_round_trip", "SELECT c_custkey AS company_id, 1 AS same, 1 AS in_range FROM customer")
def model_round_trip(spark, sf_dir):
    model = base_model(spark, sf_dir)
    path = staged_path(spark, "model")
    L.save_model(spark, model, path)
    both = L.with_scores([model, L.load_model(spark, path)], rows(spark, sf_dir), ["before", "after"])
    return both.select(
        L.KEY,
        (F.col("before") == F.col("after")).cast("int").alias("same"),
        F.col("after").between(0, 1).cast("int").alias("in_range"),
    )


@query(
    "out_of_fold_coverage",
    with_sql(
        SQL_LABELS,
        f"""SELECT company_id, shariah_compliant AS label, 1 AS in_range,
  CAST((row_number() OVER (PARTITION BY shariah_compliant ORDER BY u, company_id) - 1) % {FOLDS} AS INTEGER) AS fold
FROM (SELECT *, {UNIT} AS u FROM labels)""",
    ),
)
def out_of_fold_coverage(spark, sf_dir):
    """Every row is scored once, by a model that did not see its fold."""
    made = held_out(spark, sf_dir)[1]
    return made.select(L.KEY, L.LABEL, "fold", F.col("probability").between(0, 1).cast("int").alias("in_range"))


@query("nested_cross_validation")
def nested_cross_validation(spark, sf_dir):
    """Five outer folds; each searches two depths on three inner folds of its own training rows."""
    pooled = once(spark, sf_dir, "nested", lambda: V.nested_predictions(rows(spark, sf_dir), FEATURES, NESTED, {"depth": (3, 5)}))
    return V.nested_metrics(pooled)


def _calibrated(spark, sf_dir, method):
    models, made = held_out(spark, sf_dir)
    return once(spark, sf_dir, f"calibrated-{method}", lambda: V.calibrate_scores(models, made, method))


@query("calibrated_scores_sigmoid")
def calibrated_scores_sigmoid(spark, sf_dir):
    data = rows(spark, sf_dir)
    return _calibrated(spark, sf_dir, "sigmoid").predict(data).select(L.KEY, "probability", "prediction")


@query("calibrated_scores_isotonic")
def calibrated_scores_isotonic(spark, sf_dir):
    data = rows(spark, sf_dir)
    return _calibrated(spark, sf_dir, "isotonic").predict(data).select(L.KEY, "probability", "prediction")


def _sql_sigmoid(steps: int = 12) -> str:
    """Newton steps of the logistic curve on smoothed targets, one after the other."""
    parts = [
        """c AS (SELECT count(*) FILTER (label = 1) AS ones, count(*) FILTER (label = 0) AS zeros FROM scored),
x AS MATERIALIZED (SELECT probability AS x, CASE WHEN label = 1 THEN (ones + 1.0) / (ones + 2) ELSE 1.0 / (zeros + 2) END AS t, count(*) AS n
  FROM scored, c GROUP BY ALL),
s0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"""
    ]
    for i in range(steps):
        parts.append(
            f"""d{i} AS (SELECT a, b, sum(n * (p - t) * x) AS ga, sum(n * (p - t)) AS gb, sum(n * p * (1 - p) * x * x) AS haa,
  sum(n * p * (1 - p) * x) AS hab, sum(n * p * (1 - p)) AS hbb FROM (SELECT *, 1 / (1 + exp(-(a * x + b))) AS p FROM x, s{i}) GROUP BY a, b),
s{i + 1} AS MATERIALIZED (SELECT a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a,
  b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM d{i})"""
        )
    return with_sql(SQL_SCORED + ",\n" + ",\n".join(parts), f"SELECT round(a, 4) AS slope, round(b, 4) AS intercept FROM s{steps}")


@query("sigmoid_fit", _sql_sigmoid())
def sigmoid_fit(spark, sf_dir):
    """Platt's curve of given scores."""
    made = V.sigmoid(scored(spark, sf_dir), "probability")
    return spark.createDataFrame([(round(made.slope, 4), round(made.intercept, 4))], "slope double, intercept double")


@query(
    "isotonic_fit",
    with_sql(
        SQL_SCORED + """,
k AS (SELECT probability AS x, count(*) AS n, sum(label) AS y FROM scored GROUP BY 1),
r AS MATERIALIZED (SELECT *, sum(n) OVER (ORDER BY x) AS cn, sum(y) OVER (ORDER BY x) AS cy FROM k),
m AS MATERIALIZED (SELECT a.x AS a, b.x AS b, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n) AS mean FROM r AS a JOIN r AS b ON a.x <= b.x),
l AS (SELECT r.x, m.a, min(m.mean) AS least FROM r JOIN m ON m.a <= r.x AND m.b >= r.x GROUP BY ALL),
v AS (SELECT x, max(least) AS value FROM l GROUP BY x)""",
        "SELECT s.company_id, s.probability, round(v.value, 9) AS calibrated FROM scored AS s JOIN v ON v.x = s.probability",
    ),
)
def isotonic_fit(spark, sf_dir):
    """The monotone fit of given scores, looked up for every row; SQL takes the largest of least means."""
    given = stage(scored(spark, sf_dir).select("company_id", "label", "probability"), "given-scores")
    made = V.isotonic(given, "probability").apply(given, "probability", "calibrated")
    return made.select("company_id", "probability", F.round("calibrated", 9).alias("calibrated"))


@query("learning_curve")
def learning_curve(spark, sf_dir):
    return V.curve_of(_learned(spark, sf_dir))


def _learned(spark, sf_dir):
    return once(spark, sf_dir, "learning", lambda: V.learning_predictions(rows(spark, sf_dir), FEATURES, LEARNING))


@query(
    "learning_samples",
    with_sql(
        SQL_LABELS,
        f"""f AS (SELECT company_id, CAST((row_number() OVER (PARTITION BY shariah_compliant ORDER BY u, company_id) - 1) % {FOLDS} AS INTEGER) AS fold
  FROM (SELECT *, {UNIT} AS u FROM labels)),
w AS (SELECT company_id, fold, {UNIT.replace("|42", "|43")} AS v FROM f),
c AS (SELECT share / 10 AS share, held_out, fold = held_out AS is_held FROM w, (SELECT unnest(range(1, 11)) AS share), (SELECT unnest(range(5)) AS held_out)
  WHERE fold = held_out OR v < share / 10)
SELECT share, CAST(held_out AS INTEGER) AS held_out, CASE WHEN is_held THEN 'validation' ELSE 'train' END AS part, count(*) AS n FROM c GROUP BY ALL""",
    ).replace("FROM ruled)\nf AS", "FROM ruled),\nf AS"),
)
def learning_samples(spark, sf_dir):
    """Rows of each of the ten nested samples and of the folds held out from them."""
    return _learned(spark, sf_dir).groupBy("share", "held_out", "part").agg(F.count("*").alias("n"))


# --- ensembles -----------------------------------------------------------------------


def _voting(spark, sf_dir):
    return once(spark, sf_dir, "voting", lambda: E.fit_voting(rows(spark, sf_dir), FEATURES, PRESETS))


def _stacking(spark, sf_dir):
    return once(spark, sf_dir, "stacking", lambda: E.fit_stacking(rows(spark, sf_dir), FEATURES, S.PRESETS))


def _blending(spark, sf_dir):
    return once(spark, sf_dir, "blending", lambda: E.fit_blending(rows(spark, sf_dir), FEATURES, PRESETS))


@query("voting_ensemble")
def voting_ensemble(spark, sf_dir):
    return _voting(spark, sf_dir).predict(rows(spark, sf_dir)).select(
        L.KEY, *E.probability_columns(PRESETS), "probability", "prediction"
    )


@query("stacking_ensemble")
def stacking_ensemble(spark, sf_dir):
    return _stacking(spark, sf_dir).predict(rows(spark, sf_dir)).select(L.KEY, "probability", "prediction")


@query("stacking_consistency", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_wrong, 1 AS penalised_optimum FROM customer")
def stacking_consistency(spark, sf_dir):
    """The stacked probability is the logistic of the members' scores, and the weights zero the gradient of
    the loss plus |w| ** 2 / 2 over the out-of-fold scores."""
    fitted = _stacking(spark, sf_dir)
    names = E.probability_columns(S.PRESETS)
    meta = fitted.meta.stages[-1]
    weights = [float(w) for w in meta.coefficients]

    def logistic():
        z = F.lit(float(meta.intercept))
        for n, w in zip(names, weights):
            z = z + F.lit(w) * F.col(n)
        return 1 / (1 + F.exp(-z))

    wrong = F.abs(logistic() - F.col("probability")) > 1e-9
    gap = logistic() - F.col(L.LABEL)
    slopes = [F.abs(F.sum(gap * F.col(n)) + F.lit(w)) for n, w in zip(names, weights)]
    optimum = fitted.held_out.agg((F.greatest(*slopes, F.abs(F.sum(gap))) < F.lit(1e-3) * F.count("*")).cast("int")).scalar()
    made = fitted.predict(rows(spark, sf_dir))
    return made.agg(F.count("*").alias("n_rows"), F.count_if(wrong).alias("n_wrong")).withColumn("penalised_optimum", optimum)


@query("blending_ensemble")
def blending_ensemble(spark, sf_dir):
    fitted = _blending(spark, sf_dir)
    weights = {f"w{i + 1}": F.lit(w) for i, w in enumerate(fitted.weights)}
    return fitted.predict(rows(spark, sf_dir)).select(L.KEY, "probability", "prediction").withColumns(weights)


@query("ensemble_comparison")
def ensemble_comparison(spark, sf_dir):
    def make():
        split = stage(with_exact_split(rows(spark, sf_dir), L.KEY, L.LABEL), "compare-split")
        return E.compare(split.where(~F.col("is_test")), split.where(F.col("is_test")), FEATURES, S.PRESETS, k=3)

    return once(spark, sf_dir, "comparison", make)


# --- searches ------------------------------------------------------------------------


@query("grid_search")
def grid_search(spark, sf_dir):
    data = rows(spark, sf_dir)
    found = T.grid_search(data, FEATURES, SEARCHED, {"depth": (2, 3), "min_child_weight": (1, 5)}, k=3)
    return T.history(data, [found])


@query("random_search")
def random_search(spark, sf_dir):
    data = rows(spark, sf_dir)
    found = T.random_search(data, FEATURES, SEARCHED, S.TuningGrids().random, draws=4, k=3)
    return T.history(data, [found])


@query("staged_tuning")
def staged_tuning(spark, sf_dir):
    data = rows(spark, sf_dir)
    grids = S.TuningGrids(
        tree={"depth": (2, 3)},
        sampling={"row_sample": (0.7, 0.9)},
        learning={"learning_rate": (0.1, 0.3)},
        random={"depth": (2, 3, 4)},
        random_draws=2,
    )
    return T.history(data, T.tune(data, FEATURES, SEARCHED, grids, k=3))


# --- explanations and reports ----------------------------------------------------------


def _explained(spark, sf_dir):
    def make():
        return stage(C.row_contributions(base_model(spark, sf_dir), rows(spark, sf_dir), FEATURES), "reasons")

    return once(spark, sf_dir, "reasons", make)


@query("feature_contributions")
def feature_contributions(spark, sf_dir):
    return C.feature_contributions(_explained(spark, sf_dir))


@query("top_contributions")
def top_contributions(spark, sf_dir):
    return C.top_contributions(_explained(spark, sf_dir))


@query("global_contributions")
def global_contributions(spark, sf_dir):
    return C.global_contributions(C.feature_contributions(_explained(spark, sf_dir)))


@query("contribution_additivity", "SELECT c_custkey AS company_id, 19 AS n_features, 1 AS adds_up FROM customer")
def contribution_additivity(spark, sf_dir):
    """Base plus contributions is the margin, ln(p / (1 - p))."""
    model = base_model(spark, sf_dir)
    base = C.base_value(C.tree_boxes(model))
    total = F.aggregate("reasons", F.lit(base), lambda acc, r: acc + r["contribution"])
    sums = _explained(spark, sf_dir).select(L.KEY, total.alias("margin"), F.size("reasons").alias("n_features"))
    both = L.score(model, rows(spark, sf_dir)).join(sums, L.KEY)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
    return both.select(
        L.KEY, "n_features", (F.abs(p - F.col("probability")) < 1e-9).cast("int").alias("adds_up")
    )


@query(
    "vote_consistency",
    "SELECT c_custkey AS company_id, 1 AS is_mean, 1 AS class_follows FROM customer",
)
def vote_consistency(spark, sf_dir):
    """A soft vote is the mean of its members and its class the cut at one half."""
    voted = _voting(spark, sf_dir).predict(rows(spark, sf_dir))
    names = E.probability_columns(PRESETS)
    mean = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
    follows = (F.col("probability") >= 0.5).cast("int") == F.col("prediction")
    return voted.select(
        L.KEY,
        (F.abs(mean - F.col("probability")) < 1e-9).cast("int").alias("is_mean"),
        follows.cast("int").alias("class_follows"),
    )


@query("local_surrogate")
def surrogate(spark, sf_dir):
    return local_surrogate(base_model(spark, sf_dir), rows(spark, sf_dir), FEATURES)


@query(
    "surrogate_bins",
    with_sql(
        SQL_FEATURES,
        "\nUNION ALL\n".join(
            f"""SELECT '{f}' AS feature, CAST((x > a)::INTEGER + (b > a AND x > b)::INTEGER + (c > b AND x > c)::INTEGER AS INTEGER) AS bin,
  count(*) AS n, round(min(x), 6) AS low, round(max(x), 6) AS high FROM (SELECT {f} AS x, quantile_cont({f}, 0.25) OVER () AS a,
  quantile_cont({f}, 0.5) OVER () AS b, quantile_cont({f}, 0.75) OVER () AS c FROM features) GROUP BY 2"""
            for f in ("debt_to_assets", "roa", "f_nonhalal", "net_revenue")
        ),
    ),
)
def surrogate_bins(spark, sf_dir):
    """The quartile bins of the local surrogate with their rows and ranges."""
    names = ("debt_to_assets", "roa", "f_nonhalal", "net_revenue")
    data = rows(spark, sf_dir)
    made = bin_statistics(data, names, quartile_cuts(data, names))
    return made.select("feature", "bin", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("hybrid_model_decisions")
def hybrid_model_decisions(spark, sf_dir):
    """Rules first; edge cases get the probability of a trained model."""
    model = base_model(spark, sf_dir)
    important = [(r["feature"], r["importance"]) for r in L.importance_table(spark, model, FEATURES, 3).collect()]
    portfolio = companies(spark, sf_dir).withColumnRenamed("symbol", "ticker")
    decided = hybrid_screen(portfolio.drop("company_id"), model, important, SCREENING_RULES)
    return flat_decisions(decided)


@query("model_summary")
def model_summary(spark, sf_dir):
    predicted = L.with_prediction(L.score(base_model(spark, sf_dir), rows(spark, sf_dir)))
    measured = M.hard_metrics(M.confusion(predicted))
    return R.model_summary(spark, MODEL, FEATURES, measured)


@query("technical_report")
def report(spark, sf_dir):
    return technical_report(base_model(spark, sf_dir), MODEL, rows(spark, sf_dir), FEATURES, L.KEY)


# --- operators on given contributions and counts, checked in SQL ------------------

SQL_REASONS = SQL_FEATURES + """,
reasons AS (
  SELECT company_id, 'debt' AS feature, debt_to_assets AS value, 5.0 * (0.3 - debt_to_assets) AS contribution
  FROM features
  UNION ALL SELECT company_id, 'income', f_nonhalal, 8.0 * (0.05 - f_nonhalal) FROM features
  UNION ALL SELECT company_id, 'profit', roa, 2.0 * greatest(-1.0, least(1.0, roa)) FROM features
  UNION ALL SELECT company_id, 'interest', riba_intensity, 10.0 * (0.04 - riba_intensity) FROM features)"""


def _reasons(spark, sf_dir):
    """Contributions of a fixed additive score."""
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("roa")))
    parts = {
        "debt": ("debt_to_assets", F.lit(5.0) * (F.lit(0.3) - F.col("debt_to_assets"))),
        "income": ("f_nonhalal", F.lit(8.0) * (F.lit(0.05) - F.col("f_nonhalal"))),
        "profit": ("roa", F.lit(2.0) * bounded),
        "interest": ("riba_intensity", F.lit(10.0) * (F.lit(0.04) - F.col("riba_intensity"))),
    }
    structs = [
        F.struct(F.lit(n).alias("feature"), F.col(v).alias("value"), c.alias("contribution"))
        for n, (v, c) in parts.items()
    ]
    data = feature_table(companies(spark, sf_dir))
    return data.select(F.col("symbol").cast("long").alias(L.KEY), F.array(*structs).alias("reasons"))


@query(
    "ranked_reasons",
    with_sql(
        SQL_REASONS,
        """SELECT * FROM (SELECT company_id, feature, value, contribution,
  CASE WHEN contribution > 0 THEN 'compliant' ELSE 'non_compliant' END AS direction,
  CAST(row_number() OVER (PARTITION BY company_id ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS rank
FROM reasons) WHERE rank <= 3""",
    ),
)
def ranked_reasons(spark, sf_dir):
    return C.top_contributions(_reasons(spark, sf_dir), top=3)


@query(
    "reason_shares",
    with_sql(
        SQL_REASONS,
        """SELECT feature, round(avg(abs(contribution)), 9) AS mean_abs,
  round(100 * avg(abs(contribution)) / sum(avg(abs(contribution))) OVER (), 8) AS importance_pct
FROM reasons GROUP BY feature""",
    ),
)
def reason_shares(spark, sf_dir):
    shares = C.global_contributions(C.feature_contributions(_reasons(spark, sf_dir)))
    return shares.select(
        "feature", F.round("mean_abs", 9).alias("mean_abs"), F.round("importance_pct", 8).alias("importance_pct")
    )


@query(
    "label_report",
    with_sql(
        SQL_LABELS,
        """SELECT '{"labels":[{"total_companies":' || count(*) || ',"compliant":' || sum(shariah_compliant)
  || ',"non_compliant":' || (count(*) - sum(shariah_compliant)) || '}],"weights":[{"n_negative":'
  || count(*) FILTER (shariah_compliant = 0) || ',"n_positive":' || count(*) FILTER (shariah_compliant = 1) || '}]}'
  AS document FROM labels""",
    ),
)
def label_report(spark, sf_dir):
    made = labels(spark, sf_dir)
    return R.report_json(
        spark,
        {
            "labels": A.label_summary(made).drop("compliant_pct"),
            "weights": M.class_weight(made, "shariah_compliant").drop("scale_pos_weight"),
        },
    )
