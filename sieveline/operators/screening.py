"""Three-state decisions with reasons, as one projection.

Sector, debt, non-halal income, grey zone: the first rule that applies decides.
The rule trace holds only the rules up to the deciding one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.expressions import percent_text
from sieveline.settings import ScreeningRules

# --- fixed values: statuses, violations, rule names ----------------------------
COMPLIANT, NON_COMPLIANT, EDGE_CASE = "COMPLIANT", "NON_COMPLIANT", "EDGE_CASE"
HARAM_SECTOR = "HARAM_SECTOR"
EXCESSIVE_DEBT = "EXCESSIVE_DEBT"
EXCESSIVE_NONHALAL = "EXCESSIVE_NONHALAL"
AMBIGUOUS = "AMBIGUOUS"

RULE_SECTOR = "Haram Sector"
RULE_DEBT = "F_RIBA (Debt-to-Assets)"
RULE_NONHALAL = "F_NONHALAL (Income Purity)"

_NO_TEXT = "array<string>"


def _texts(*items: Column) -> Column:
    """The non-null texts, in order."""
    return F.array_compact(F.array(*items)) if items else F.array().cast(_NO_TEXT)


def _rule(name: str, passed: Column, value: Column, limit: float, text: Column) -> Column:
    return F.struct(
        F.lit(name).alias("rule"),
        passed.alias("passed"),
        F.round(value, 4).alias("value"),
        F.lit(round(limit, 4)).alias("threshold"),
        F.lit("CRITICAL").alias("severity"),
        text.alias("explanation"),
    )


def _limit_text(label: str, value: Column, passed: Column, limit: float) -> Column:
    sign = F.when(passed, F.lit(" < ")).otherwise(F.lit(" ≥ "))
    return F.concat(F.lit(label), percent_text(value), sign, F.lit(f"{limit:.0%}"))


def screen(
    companies: DataFrame,
    rules: ScreeningRules = ScreeningRules(),
    null_checked: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Decide every company; ``ticker`` and ``company_name`` are carried along.

    A null in any of ``null_checked`` (all input columns by default) or zero
    assets make an otherwise passing company an edge case. ``keep`` names
    input columns to carry into the result.
    """
    checked = list(null_checked if null_checked is not None else companies.columns)
    sector = F.coalesce(F.trim("sector"), F.lit("nan"))
    debt = F.try_divide(F.col("total_liabilities").cast("double"), F.col("total_assets").cast("double"))
    income = F.col("nonhalal_revenue_percent").cast("double")
    banned = F.lit(False)
    for term in rules.haram_terms:
        banned = banned | F.contains(F.col("_sector"), F.lit(term))
    incomplete = F.col("total_assets") == 0
    for c in checked:
        incomplete = incomplete | F.col(f"`{c}`").isNull()
        if companies.schema[c].dataType.typeName() in ("double", "float"):
            incomplete = incomplete | F.isnan(F.col(f"`{c}`"))

    facts = companies.withColumns(
        {
            "_sector": sector,
            "_debt": debt,
            "_income": income,
            "_incomplete": F.coalesce(incomplete, F.lit(True)),
        }
    ).withColumns(
        {
            "_sector_ok": ~banned,
            "_debt_ok": F.coalesce(F.col("_debt") < rules.debt_limit, F.lit(False)),
            "_income_ok": F.coalesce(F.col("_income") < rules.nonhalal_limit, F.lit(False)),
        }
    )
    debt, income = F.col("_debt"), F.col("_income")
    sector_ok, debt_ok, income_ok = F.col("_sector_ok"), F.col("_debt_ok"), F.col("_income_ok")

    def zone(value: Column, band: tuple[float, float], limit: float, label: str) -> Column:
        text = F.concat(
            F.lit(f"Borderline {label}: "),
            percent_text(value),
            F.lit(f" (warning zone: {band[0]:.0%}-{band[1]:.0%})"),
        )
        return F.when((value >= band[0]) & (value < limit), text)

    edge = _texts(
        zone(debt, rules.debt_zone, rules.debt_limit, "debt ratio"),
        zone(income, rules.nonhalal_zone, rules.nonhalal_limit, "non-halal income"),
        F.when(F.col("_incomplete"), F.lit("Incomplete or noisy financial data")),
    )
    status = (
        F.when(~sector_ok | ~debt_ok | ~income_ok, F.lit(NON_COMPLIANT))
        .when(F.size("_edge") > 0, F.lit(EDGE_CASE))
        .otherwise(F.lit(COMPLIANT))
    )
    violation = (
        F.when(~sector_ok, F.lit(HARAM_SECTOR))
        .when(~debt_ok, F.lit(EXCESSIVE_DEBT))
        .when(~income_ok, F.lit(EXCESSIVE_NONHALAL))
        .when(F.col("status") == EDGE_CASE, F.lit(AMBIGUOUS))
    )
    tested = F.when(~sector_ok, 1).when(~debt_ok, 2).otherwise(3)
    trace = F.array(
        _rule(
            RULE_SECTOR,
            sector_ok,
            F.when(sector_ok, 0.0).otherwise(1.0),
            0.0,
            F.concat(
                F.lit("Sector: "),
                F.col("_sector"),
                F.when(sector_ok, F.lit(" (Permissible)")).otherwise(F.lit(" (HARAM)")),
            ),
        ),
        _rule(RULE_DEBT, debt_ok, debt, rules.debt_limit, _limit_text("Debt exposure ", debt, debt_ok, rules.debt_limit)),
        _rule(
            RULE_NONHALAL,
            income_ok,
            income,
            rules.nonhalal_limit,
            _limit_text("Non-halal income ", income, income_ok, rules.nonhalal_limit),
        ),
    )
    debt_cap, income_cap = f"{rules.debt_limit:.1%}", f"{rules.nonhalal_limit:.1%}"
    risks = (
        F.when(
            ~sector_ok,
            _texts(F.concat(F.lit("Operates in haram sector: "), F.coalesce("sector", F.lit("nan")))),
        )
        .when(
            ~debt_ok,
            _texts(F.concat(F.lit("Excessive debt exposure: "), percent_text(debt), F.lit(f" > {debt_cap}"))),
        )
        .when(
            ~income_ok,
            _texts(
                F.concat(F.lit("Excessive non-halal income: "), percent_text(income), F.lit(f" > {income_cap}"))
            ),
        )
        .otherwise(F.col("_edge"))
    )
    support = F.when(
        F.col("status") == COMPLIANT,
        _texts(
            F.lit("Passes all hard Shariah rules"),
            F.concat(F.lit("Debt ratio: "), percent_text(debt), F.lit(f" < {debt_cap}")),
            F.concat(F.lit("Non-halal income: "), percent_text(income), F.lit(f" < {income_cap}")),
        ),
    ).otherwise(F.array().cast(_NO_TEXT))

    decided = facts.withColumn("_edge", edge).withColumn("status", status)
    return decided.select(
        "ticker",
        "company_name",
        "status",
        F.lit(1.0).alias("final_confidence"),
        F.slice(trace, F.lit(1), tested).alias("rules"),
        _texts(violation).alias("violations"),
        F.lit(None).cast("double").alias("ml_confidence"),
        F.lit(None).cast("double").alias("ml_score"),
        risks.alias("risk_factors"),
        support.alias("supporting_factors"),
        *keep,
    )


def with_model_confidence(
    decisions: DataFrame,
    probability: str | Column,
    importance: Sequence[tuple[str, float]] = (),
    top: int = 3,
    floor: float = 0.05,
) -> DataFrame:
    """Score the edge cases: confidence = 0.5 + 0.5 p, with model reasons.

    ``probability`` is a column of ``decisions`` (null leaves a row unscored).
    The ``top`` most important features above ``floor`` support the decision
    when p > 0.5 and count as risks otherwise.
    """
    p = F.col(probability) if isinstance(probability, str) else probability
    scored = (F.col("status") == EDGE_CASE) & p.isNotNull()
    best = sorted(importance, key=lambda pair: -pair[1])[:top]
    reasons = F.array(
        *[F.lit(f"ML: {name} (importance: {weight:.1%})") for name, weight in best if weight > floor]
    ).cast(_NO_TEXT)

    def extended(name: str, when: Column) -> Column:
        return F.when(scored & when, F.concat(F.col(name), reasons)).otherwise(F.col(name))

    return decisions.withColumns(
        {
            "ml_score": F.when(scored, p).otherwise(F.col("ml_score")),
            "ml_confidence": F.when(scored, p).otherwise(F.col("ml_confidence")),
            "final_confidence": F.when(scored, F.lit(0.5) + p * F.lit(0.5)).otherwise(
                F.col("final_confidence")
            ),
            "supporting_factors": extended("supporting_factors", p > 0.5),
            "risk_factors": extended("risk_factors", p <= 0.5),
        }
    )


def edge_features(decisions: DataFrame, features: DataFrame, key: str = "ticker") -> DataFrame:
    """The feature rows of the edge cases, one join for all of them."""
    edges = decisions.where(F.col("status") == EDGE_CASE).select(key)
    return edges.join(features, key)


def as_record(decisions: DataFrame) -> DataFrame:
    """Round for output; a score of exactly 0 becomes null."""
    return decisions.withColumns(
        {
            "final_confidence": F.round("final_confidence", 4),
            "ml_confidence": F.round(F.nullif(F.col("ml_confidence"), F.lit(0.0)), 4),
            "ml_score": F.round(F.nullif(F.col("ml_score"), F.lit(0.0)), 4),
        }
    )


def flat_decisions(decisions: DataFrame) -> DataFrame:
    """One flat row per company, violations joined, empty as ``None``."""
    joined = F.array_join("violations", "; ")
    return decisions.select(
        "ticker",
        "company_name",
        "status",
        "final_confidence",
        "ml_score",
        F.coalesce(F.nullif(joined, F.lit("")), F.lit("None")).alias("violations"),
    )


def rule_trace(decisions: DataFrame) -> DataFrame:
    """One row per tested rule."""
    return decisions.select("ticker", F.posexplode("rules").alias("position", "r")).select(
        "ticker", "position", "r.*"
    )


def violation_counts(decisions: DataFrame) -> DataFrame:
    return decisions.select("ticker", F.size("violations").alias("n_violations"))
