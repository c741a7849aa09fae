"""Deterministic overrides of a model, tiers, targets and recommendations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.expressions import any_of, known
from sieveline.settings import (
    METRIC_TARGETS,
    MODEL_FEATURES,
    STATEMENT_YEARS,
    DeploymentGuardrails,
    Guardrails,
)


def _banned(sectors: tuple[str, ...], sector: str) -> Column:
    return F.coalesce(any_of(sectors, F.col(sector)), F.lit(False))


def guardrail_decision(
    rules: Guardrails = Guardrails(),
    sector: str = "sector",
    riba: str = "f_riba",
    nonhalal: str = "f_nonhalal",
) -> Column:
    """0 where a guardrail rejects, else 1. Null and NaN ratios are not rejected."""
    high_debt = F.coalesce(known(riba) > rules.riba_limit, F.lit(False))
    impure = F.coalesce(known(nonhalal) > rules.nonhalal_limit, F.lit(False))
    return F.when(_banned(rules.prohibited_sectors, sector) | high_debt | impure, 0).otherwise(1)


def guardrail_cases(df: DataFrame, rules: Guardrails = Guardrails(), sector: str = "sector") -> DataFrame:
    """Per violation kind: rows, rejection rate and PASS when all are rejected.

    One pass over the table for all three cases.
    """
    subsets = {
        "TC-001": known("f_riba") > rules.riba_limit,
        "TC-002": known("f_nonhalal") > rules.nonhalal_limit,
        "TC-003": _banned(rules.prohibited_sectors, sector),
    }
    rejected = guardrail_decision(rules, sector) == 0
    sums = []
    for name, inside in subsets.items():
        sums += [F.count_if(inside).alias(f"n_{name}"), F.count_if(inside & rejected).alias(f"r_{name}")]
    rows = [
        F.struct(
            F.lit(name).alias("case_id"),
            F.col(f"n_{name}").alias("n_rows"),
            F.coalesce(F.try_divide(F.col(f"r_{name}"), F.col(f"n_{name}")), F.lit(0.0)).alias("rejection_rate"),
        )
        for name in subsets
    ]
    table = df.agg(*sums).select(F.inline(F.array(*rows)))
    verdict = F.when(F.col("rejection_rate") == 1.0, F.lit("PASS")).otherwise(F.lit("FAIL"))
    return table.withColumn("result", verdict)


def guarded_decision(
    df: DataFrame,
    rules: DeploymentGuardrails = DeploymentGuardrails(),
    probability: str = "probability",
    riba: str = "riba_intensity",
    debt: str = "debt_to_equity",
    sector: str = "sector",
) -> DataFrame:
    """Compliant when the model says so and every guardrail passes.

    The riba measure is interest intensity and the debt measure debt to
    equity; both are parameters.
    """
    passes = (
        ~_banned(rules.prohibited_sectors, sector)
        & F.coalesce(F.col(riba) <= rules.riba_limit, F.lit(False))
        & F.coalesce(F.col(debt) <= rules.debt_limit, F.lit(False))
    )
    model = F.coalesce(F.col(probability) >= rules.decision_threshold, F.lit(False))
    return df.withColumns(
        {
            "model_decision": model.cast("int"),
            "guardrails_passed": passes.cast("int"),
        }
    ).withColumn("final_decision", F.col("model_decision") * F.col("guardrails_passed"))


def guardrail_pass_rate(guarded: DataFrame) -> DataFrame:
    return guarded.agg(F.avg("guardrails_passed").alias("guardrail_pass_rate"))


def confidence_status(c: str = "confidence") -> Column:
    """High above 0.85, Medium above 0.70, else Low."""
    return F.when(known(c) > 0.85, "High").when(known(c) > 0.70, "Medium").otherwise("Low")


def probability_tier(c: str = "probability") -> Column:
    """Bands above 0.80, 0.45 to 0.80 and below 0.45."""
    return (
        F.when(known(c) > 0.80, "compliant").when(known(c) >= 0.45, "borderline").otherwise("non_compliant")
    )


def check_targets(metrics: DataFrame, targets: Mapping[str, float] = METRIC_TARGETS) -> DataFrame:
    """(metric, value) rows against their targets."""
    pairs = [F.lit(x) for item in targets.items() for x in item]
    target = F.try_element_at(F.create_map(*pairs), F.col("metric"))
    with_target = metrics.withColumn("target", target).where(F.col("target").isNotNull())
    return with_target.withColumn("met", F.coalesce(F.col("value") >= F.col("target"), F.lit(False)))


def recommendations(
    metrics: DataFrame,
    n_features: int = len(MODEL_FEATURES),
    period: str = f"{STATEMENT_YEARS[0]}-{STATEMENT_YEARS[-1]}",
    top_feature: tuple[str, float] | None = None,
) -> DataFrame:
    """(category, status, metric, value, detail) for a deployment, from ``accuracy``, ``auc`` and ``compliant_share``.

    One input row of fractions gives one output row per category; a status of
    NOTE states a fact to keep in view. ``top_feature`` is a name with its
    importance share.
    """
    accuracy, auc, share = F.col("accuracy"), F.col("auc"), F.col("compliant_share")
    level = F.when(accuracy >= 0.9, "EXCELLENT").when(accuracy >= 0.8, "GOOD").otherwise("CAUTION")
    balance = F.when(share.between(0.3, 0.7), "BALANCED").otherwise("IMBALANCED")
    number, text = lambda x: F.lit(x).cast("double"), lambda x: F.lit(x).cast("string")

    def row(category: str, status: Column, metric: str, value: Column, detail: str | None = None) -> Column:
        return F.struct(
            F.lit(category).alias("category"),
            status.alias("status"),
            F.lit(metric).alias("metric"),
            value.cast("double").alias("value"),
            text(detail).alias("detail"),
        )

    note = F.lit("NOTE")
    rows = [
        row("Performance", level, "accuracy", accuracy),
        F.when(auc >= 0.9, row("Confidence", F.lit("HIGH"), "auc", auc)),
        row("Data Balance", balance, "compliant_share", share),
        row("Deployment", note, "input_features", number(n_features)),
        row("Monitoring", note, "compliant_share", share),
        row("Updates", note, "training_period", number(None), period),
    ]
    if top_feature:
        rows.append(row("Features", note, "importance", number(top_feature[1]), top_feature[0]))
    return metrics.select(F.inline(F.array_compact(F.array(*rows))))
