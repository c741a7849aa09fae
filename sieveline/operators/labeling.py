"""Binary labels from a sector rule and five ratio rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.expressions import any_of, known, ratio
from sieveline.settings import LabelRules

RULE_FLAGS = (
    "debt_to_assets_ok",
    "interest_income_ok",
    "interest_bearing_debt_ok",
    "profitability_ok",
    "equity_ok",
)
RULE_VALUES = (
    "debt_to_assets_value",
    "interest_income_value",
    "interest_bearing_debt_value",
    "roa_value",
    "equity_ratio_value",
)


def _first_present(df: DataFrame, *names: str) -> Column:
    """The first of ``names`` that exists as a column, else null."""
    have = next((n for n in names if n in df.columns), None)
    return known(have) if have else F.lit(None).cast("double")


def _or_ratio(df: DataFrame, name: str, num: str, den: str) -> Column:
    """The column ``name``, recomputed from its parts where it is null."""
    value = _first_present(df, name)
    if num in df.columns and den in df.columns:
        both = known(num).isNotNull() & known(den).isNotNull()
        value = F.coalesce(value, F.when(both, ratio(num, den)))
    return value


def rule_values(df: DataFrame) -> dict[str, Column]:
    """The tested value of every rule. A missing column falls back to its proxy."""
    return {
        "debt_to_assets_value": _first_present(df, "debt_to_assets", "f_riba"),
        "interest_income_value": _first_present(
            df, "interest_income_ratio", "f_nonhalal", "nonhalal_revenue_percent"
        ),
        "interest_bearing_debt_value": _first_present(df, "interest_bearing_debt_ratio", "f_riba"),
        "roa_value": _or_ratio(df, "roa", "net_income", "total_assets"),
        "equity_ratio_value": _or_ratio(df, "equity_ratio", "total_equity", "total_assets"),
    }


def with_financial_rules(df: DataFrame, rules: LabelRules = LabelRules()) -> DataFrame:
    """Add five values, five flags and their conjunction. A null or NaN value fails its rule."""
    df = df.withColumns(rule_values(df))
    tests = {
        "debt_to_assets_ok": F.col("debt_to_assets_value") <= rules.debt_to_assets_max,
        "interest_income_ok": F.col("interest_income_value") <= rules.interest_income_max,
        "interest_bearing_debt_ok": F.col("interest_bearing_debt_value")
        <= rules.interest_bearing_debt_max,
        "profitability_ok": F.col("roa_value") >= rules.roa_min,
        "equity_ok": F.col("equity_ratio_value") >= rules.equity_ratio_min,
    }
    df = df.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in tests.items()})
    passed = F.lit(True)
    for flag in RULE_FLAGS:
        passed = passed & F.col(flag)
    return df.withColumn("financial_compliant", passed.cast("int"))


def with_sector_rule(df: DataFrame, rules: LabelRules = LabelRules()) -> DataFrame:
    """Exact match against the prohibited sectors; a null sector passes."""
    banned = F.coalesce(any_of(rules.prohibited_sectors, F.col("sector")), F.lit(False))
    return df.withColumn("sector_compliant", (~banned).cast("int"))


def label_companies(
    df: DataFrame, rules: LabelRules = LabelRules(), keep: Sequence[str] = ()
) -> DataFrame:
    """The label table: flags, values and the overall label.

    ``keep`` names input columns to carry along, which saves a join.
    """
    ruled = with_sector_rule(with_financial_rules(df, rules), rules)
    overall = (F.col("sector_compliant") == 1) & (F.col("financial_compliant") == 1)
    return ruled.withColumn("shariah_compliant", overall.cast("int")).select(
        "symbol",
        "sector",
        "sector_compliant",
        "financial_compliant",
        "shariah_compliant",
        *RULE_FLAGS,
        *RULE_VALUES,
        *keep,
    )
