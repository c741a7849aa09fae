"""The screening jobs from input to result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline import settings as S
from sieveline.operators.features import (
    base_amounts,
    feature_table,
    model_input,
    sector_code,
    with_ratios,
)
from sieveline.operators.boosting import BoostedTrees
from sieveline.operators.contributions import row_contributions, top_contributions
from sieveline.operators.guardrails import recommendations
from sieveline.operators.labeling import label_companies
from sieveline.operators.metrics import auc, confusion, confusion_metrics, hard_metrics
from sieveline.operators.models import (
    TrainedScorer,
    importance_table,
    prediction_table,
    score,
    train_scorer,
    training_rows,
    with_prediction,
)
from sieveline.operators.report import model_summary, report_json
from sieveline.operators.reshape import (
    aggregate_years,
    attach_sector,
    canonical_amounts,
    company_accounts,
    drop_sparse,
)
from sieveline.operators.screening import flat_decisions, screen, with_model_confidence
from sieveline.operators.summaries import confidence_histogram, dataset_summary, prediction_statistics
from sieveline.sources.readers import labeled_features
from sieveline.sources.staging import stage


def companies_from_statements(
    statements: DataFrame,
    years: Sequence[str] = S.STATEMENT_YEARS,
    method: str = "mean",
    null_threshold: float = 0.5,
    aliases: Mapping[str, Sequence[str]] = S.ACCOUNT_ALIASES,
) -> DataFrame:
    """Long statements to one row per company with the canonical amounts.

    The raw statements are read once, into a staged table of one value per
    company and account. Companies that lack too many accounts are dropped on
    that table, and only the accounts some alias names are pivoted.
    """
    accounts = stage(company_accounts(aggregate_years(statements, years, method)), "accounts")
    kept = drop_sparse(accounts, null_threshold).select("symbol")
    return canonical_amounts(accounts.join(kept, "symbol", "left_semi"), aliases)


def labels_from_statements(
    statements: DataFrame,
    sectors: DataFrame,
    rules: S.LabelRules = S.LabelRules(),
    legacy_sector: bool = False,
    **reshape,
) -> tuple[DataFrame, DataFrame]:
    """(features, labels) of a statement table.

    The sector is joined before the features, so the sector code is real.
    ``legacy_sector`` keeps the default code in the features.
    """
    companies = companies_from_statements(statements, **reshape)
    named = attach_sector(companies, sectors)
    features = feature_table(named, legacy_sector)
    labels = label_companies(attach_sector(features, sectors) if legacy_sector else features, rules)
    return features, labels


def screen_portfolio(
    portfolio: DataFrame,
    rules: S.ScreeningRules = S.ScreeningRules(),
    probability: str | None = None,
    importance: Sequence[tuple[str, float]] = (),
    null_checked: Sequence[str] | None = None,
) -> DataFrame:
    """Flat decisions for a portfolio; edge cases use ``probability`` if given.

    The probability comes as a column of the portfolio (for instance from a
    model's ``transform``), so scoring needs no join.
    """
    keep = [probability] if probability else []
    checked = [c for c in (null_checked or portfolio.columns) if c != probability]
    decided = screen(portfolio, rules, checked, keep)
    if probability:
        decided = with_model_confidence(decided, probability, importance)
    return flat_decisions(decided)


def hybrid_screen(
    portfolio: DataFrame,
    model: BoostedTrees,
    importance: Sequence[tuple[str, float]] = (),
    rules: S.ScreeningRules = S.ScreeningRules(),
    null_checked: Sequence[str] | None = None,
) -> DataFrame:
    """Nested decisions; edge cases get the probability of ``model``.

    The inputs travel with the decision, so features, score and decision are
    one pass over the portfolio without a join.
    """
    inputs = ["sector", *S.AMOUNTS]
    decided = screen(portfolio, rules, null_checked, keep=inputs)
    kept = [c for c in decided.columns if c not in inputs]
    features = with_ratios(base_amounts(decided, [*kept, "sector"]))
    coded = features.withColumn("sector_encoded", sector_code(F.col("sector")))
    return with_model_confidence(score(model, coded), "probability", importance).select(*kept)


def train_and_evaluate(
    labels: DataFrame,
    features: DataFrame,
    params: S.BoostParams = S.SCORER_MODEL,
    key: str = "symbol",
    **options,
) -> TrainedScorer:
    """Join labels and features, then split, train, pick the threshold and measure."""
    joined, inputs = labeled_features(labels, features)
    rows = training_rows(joined, inputs, "shariah_compliant", key)
    return train_scorer(rows, inputs, params, **options)


def explain_predictions(
    model: BoostedTrees, rows: DataFrame, features: Sequence[str], key: str, top: int = 10
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, top reasons per row, importance) of one model."""
    predictions = prediction_table(score(model, rows), key)
    reasons = top_contributions(row_contributions(model, rows, features, key), key, top)
    return predictions, reasons, importance_table(rows.sparkSession, model, features)


def technical_report(
    model: BoostedTrees,
    params: S.BoostParams,
    rows: DataFrame,
    features: Sequence[str],
    key: str,
    threshold: float = 0.5,
) -> DataFrame:
    """One JSON document: model, metrics, predictions, importance, data, advice.

    The predictions are staged once; every section is a small aggregate of them.
    """
    spark = rows.sparkSession
    predicted = stage(with_prediction(score(model, rows), threshold), "predicted")
    counts = stage(confusion(predicted), "counts")
    importance = importance_table(spark, model, features)
    top = importance.first()
    headline = hard_metrics(counts, ("accuracy",)).withColumns(
        {
            "auc": auc(predicted).scalar(),
            "compliant_share": predicted.agg(F.avg(F.col("prediction").cast("double"))).scalar(),
        }
    )
    return report_json(
        spark,
        {
            "model_summary": model_summary(spark, params, features, hard_metrics(counts), threshold),
            "confusion_matrix": confusion_metrics(counts),
            "prediction_statistics": prediction_statistics(predicted, "prediction"),
            "confidence_distribution": confidence_histogram(predicted),
            "feature_importance": importance,
            "data": dataset_summary(rows, "training rows", key),
            "recommendations": recommendations(
                headline, len(features), top_feature=(top["feature"], top["importance_pct"] / 100)
            ),
        },
    )


def permit_decisions(
    scored: DataFrame, keep: Sequence[str] = ("ticker", "company_name"), threshold: float = 0.5
) -> DataFrame:
    """PERMIT or REJECT with both probabilities, from a ``probability`` column."""
    p = F.col("probability")
    return scored.select(
        *keep,
        F.when(p >= threshold, "PERMIT").otherwise("REJECT").alias("decision"),
        p.alias("permit_probability"),
        (F.lit(1.0) - p).alias("reject_probability"),
    )


def score_portfolio(
    portfolio: DataFrame,
    model: BoostedTrees,
    features: Sequence[str] = S.MODEL_FEATURES,
    keep: Sequence[str] = ("ticker", "company_name"),
    threshold: float = 0.5,
) -> DataFrame:
    """Permit decisions of a model for a portfolio that carries the features."""
    missing = [f for f in features if f not in portfolio.columns]
    if missing:
        raise ValueError(f"portfolio lacks the columns {', '.join(missing)}")
    return permit_decisions(score(model, model_input(portfolio, features, keep)), keep, threshold)


def portfolio_summary(predictions: DataFrame, prediction: str = "predicted_compliant") -> DataFrame:
    """Permit and reject counts with their shares."""
    p, n = F.col(prediction), F.count("*")
    return predictions.agg(
        n.alias("n_companies"),
        F.count_if(p == 1).alias("n_permit"),
        F.count_if(p == 0).alias("n_reject"),
        F.avg((p == 1).cast("double")).alias("permit_share"),
        F.avg((p == 0).cast("double")).alias("reject_share"),
    )
