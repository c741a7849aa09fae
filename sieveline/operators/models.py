"""Training, scoring and evaluation of boosted-tree models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import settings as S
from sieveline.operators import boosting as B
from sieveline.operators import metrics as M
from sieveline.operators.splits import with_exact_split, with_stratified_folds
from sieveline.operators.thresholds import SEARCH_GRID, best_threshold, threshold_metrics
from sieveline.sources.staging import stage

LABEL, KEY = "label", "company_id"
CV_METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")
#: Trees without a better validation loss after which boosting ends (fixed value).
PATIENCE = 20


def training_rows(df: DataFrame, features: Sequence[str], label: str, key: str) -> DataFrame:
    """Key, label and null-free features, staged so that every fit reads them once per pass."""
    filled = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]
    rows = df.where(F.col(label).isNotNull()).select(
        F.col(key).alias(KEY), F.col(label).cast("int").alias(LABEL), *filled
    )
    return stage(rows, "training-rows")


def fit_all(df: DataFrame, features: Sequence[str], fits: Sequence[B.Fit]) -> list[B.BoostedTrees]:
    """The models of several settings and row sets, fitted in the same passes."""
    return B.fit_many(df, features, fits, KEY, LABEL)


def fit(df: DataFrame, features: Sequence[str], params: S.BoostParams) -> B.BoostedTrees:
    return fit_all(df, features, [B.Fit(params)])[0]


def score(model, df: DataFrame, name: str = "probability") -> DataFrame:
    """Add P(1) as one double column. ``model`` is a boosted model or a fitted MLlib pipeline."""
    if isinstance(model, B.BoostedTrees):
        return df.withColumn(name, F.get(B.probability_column([model]), F.lit(0)))
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    extra = [c for c in ("features", "rawPrediction", "prediction") if c not in df.columns]
    return out.drop(*extra) if name == "probability" else out.drop(*extra, "probability")


def with_scores(models: Sequence[B.BoostedTrees], df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add P(1) of every model in one pass over the features."""
    made = df.withColumn("_scores", B.probability_column(models))
    return made.withColumns({n: F.get("_scores", F.lit(i)) for i, n in enumerate(names)}).drop("_scores")


def with_prediction(scored: DataFrame, threshold: float = 0.5, probability: str = "probability") -> DataFrame:
    """Add the class, the confidence and whether the class is right."""
    p = F.col(probability)
    out = scored.withColumns(
        {"prediction": (p >= threshold).cast("int"), "confidence": F.greatest(p, F.lit(1.0) - p)}
    )
    if LABEL in out.columns:
        out = out.withColumn("correct", (F.col(LABEL) == F.col("prediction")).cast("int"))
    return out


def prediction_table(scored: DataFrame, key: str = "symbol", threshold: float = 0.5) -> DataFrame:
    """The prediction columns of a scored table, with the non-compliant probability."""
    out = with_prediction(scored, threshold)
    return out.select(
        key,
        F.col(LABEL).alias("shariah_compliant"),
        F.col("prediction").alias("predicted_compliant"),
        F.col("probability").alias("compliance_probability"),
        (F.lit(1.0) - F.col("probability")).alias("non_compliance_probability"),
        "confidence",
        F.col("correct").alias("prediction_correct"),
    )


def positive_weight(df: DataFrame) -> float:
    return float(M.class_weight(df, LABEL).first()["scale_pos_weight"])


def out_of_fold(
    folded: DataFrame, features: Sequence[str], params: Sequence[S.BoostParams], k: int, names: Sequence[str], fold: str = "fold"
) -> DataFrame:
    """P(1) of every setting for every row, by the models that did not see its fold; all are fitted together."""
    return held_out_scores(folded, fit_all(folded, features, fold_fits(params, k, fold)), k, names, fold)


def fold_fits(params: Sequence[S.BoostParams], k: int, fold: str = "fold") -> list[B.Fit]:
    """Every setting without each of the folds, the folds of a setting in a row."""
    return [B.Fit(p, f"{fold} <> {i}") for p in params for i in range(k)]


def held_out_scores(folded: DataFrame, models: Sequence[B.BoostedTrees], k: int, names: Sequence[str], fold: str = "fold") -> DataFrame:
    """``folded`` with P(1) by the models of ``fold_fits`` that did not see a row's fold, staged."""
    scored = folded.withColumn("_scores", B.probability_column(models))
    own = {n: F.get("_scores", F.lit(j * k) + F.col(fold)) for j, n in enumerate(names)}
    return stage(scored.withColumns(own).drop("_scores"), "out-of-fold")


def fold_predictions(
    df: DataFrame,
    features: Sequence[str],
    params: S.BoostParams,
    k: int = 5,
    seed: int = 42,
    name: str = "probability",
) -> DataFrame:
    """Out-of-fold P(1) for every row, staged. Folds are stratified."""
    folded = stage(with_stratified_folds(df, KEY, LABEL, k, seed), "folds")
    return out_of_fold(folded, features, [params], k, [name])


def fold_metrics(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per fold with accuracy, precision, recall, F1 and AUC."""
    hard = M.hard_metrics(
        M.confusion(with_prediction(predictions, threshold), by=["fold"]),
        ("accuracy", "precision", "recall", "f1"),
    )
    ranking = M.auc(predictions, by=["fold"]).withColumnRenamed("auc", "roc_auc")
    return hard.join(ranking, "fold", "left")


def cross_validate(
    df: DataFrame, features: Sequence[str], params: S.BoostParams, k: int = 5, seed: int = 42
) -> DataFrame:
    """(metric, mean, std, n_folds) of k-fold training."""
    per_fold = fold_metrics(fold_predictions(df, features, params, k, seed))
    return M.fold_summary(per_fold, CV_METRICS)


@dataclass(frozen=True)
class TrainedScorer:
    """A model with its decision threshold and its test and fold metrics."""

    model: B.BoostedTrees
    features: tuple[str, ...]
    threshold: float
    params: S.BoostParams
    test_metrics: DataFrame
    cv_f1: DataFrame

    def predict(self, df: DataFrame) -> DataFrame:
        return with_prediction(score(self.model, df), self.threshold)


def train_scorer(
    df: DataFrame,
    features: Sequence[str],
    params: S.BoostParams = S.SCORER_MODEL,
    test_size: float = 0.2,
    cv_folds: int = 5,
    weigh_classes: bool = True,
    search_threshold: bool = True,
    seed: int = 42,
) -> TrainedScorer:
    """Split, weigh the classes, fit, pick the threshold and measure.

    The driver holds the parameters, the weight and the threshold, never rows.
    """
    split = stage(with_exact_split(df, KEY, LABEL, test_size, seed), "split")
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    if weigh_classes:
        params = replace(params, positive_weight=positive_weight(train))
    model = fit(train, features, params)
    tested = stage(score(model, test), "tested")
    threshold = 0.5
    if search_threshold:
        threshold = float(best_threshold(threshold_metrics(tested, SEARCH_GRID)).first()["threshold"])
    hard = M.hard_metrics(M.confusion(with_prediction(tested, threshold)))
    measured = hard.withColumn("auc", M.auc(tested).scalar())
    folds = fold_metrics(fold_predictions(train.drop("is_test"), features, params, cv_folds, seed), threshold)
    return TrainedScorer(
        model, tuple(features), threshold, params, measured, M.fold_summary(folds, ["f1"])
    )


def fit_early_stopping(
    df: DataFrame,
    features: Sequence[str],
    params: S.BoostParams = S.EARLY_STOP_MODEL,
    validation_share: float = 0.2,
    patience: int = PATIENCE,
    seed: int = 42,
) -> B.BoostedTrees:
    """Fit with a stratified held-out part that ends boosting.

    The log loss of the held-out part is measured after every tree. Boosting
    ends when it has not improved for ``patience`` trees, and the model keeps
    the trees up to its smallest loss.
    """
    marked = stage(with_exact_split(df, KEY, LABEL, validation_share, seed, "is_validation"), "early-stopping")
    return fit_all(marked, features, [B.Fit(params, "not is_validation", "is_validation", patience)])[0]


def loss_table(spark: SparkSession, model: B.BoostedTrees) -> DataFrame:
    """(n_trees, train_loss, validation_loss, is_best), a row per boosting round."""
    rows = [(i, *pair, i == model.best_round) for i, pair in enumerate(model.losses)]
    return spark.createDataFrame(rows, "n_trees int, train_loss double, validation_loss double, is_best boolean")


def importance_table(
    spark: SparkSession, model: B.BoostedTrees, features: Sequence[str], top: int | None = None
) -> DataFrame:
    """(rank, feature, importance, importance_pct), largest first: the mean gain of a feature's splits as a share.

    The table has one row per feature, so it is made on the driver.
    """
    values = dict(zip(model.features, model.importances()))
    order = sorted(range(len(features)), key=lambda i: (-values[features[i]], i))[:top]
    rows = [(r + 1, features[i], float(values[features[i]]), float(values[features[i]]) * 100) for r, i in enumerate(order)]
    return spark.createDataFrame(rows, "rank int, feature string, importance double, importance_pct double")


def save_model(spark: SparkSession, model: B.BoostedTrees, path: str) -> None:
    B.save(spark, model, path)


def load_model(spark: SparkSession, path: str) -> B.BoostedTrees:
    return B.load(spark, path)
