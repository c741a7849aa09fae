"""Schemas of the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

from sieveline import settings as S
from sieveline.functions.expressions import plain_account_py


def statement_schema(years: Sequence[str] = S.STATEMENT_YEARS) -> T.StructType:
    """Long statements. Amounts stay text, they are parsed on reshape."""
    names = ["symbol", "account", "type", *years]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def processed_schema(accounts: Sequence[str]) -> T.StructType:
    """Wide companies: symbol and one amount per account."""
    amounts = [T.StructField(plain_account_py(a), T.DoubleType()) for a in accounts]
    return T.StructType([T.StructField("symbol", T.StringType()), *amounts])


SECTOR_MAP = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("sector", T.StringType())]
)

FEATURES = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("sector", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in S.MODEL_FEATURES[:-1]]
    + [T.StructField("sector_encoded", T.IntegerType())]
)

LABELS = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("sector", T.StringType())]
    + [
        T.StructField(n, T.IntegerType())
        for n in ("sector_compliant", "financial_compliant", "shariah_compliant")
    ]
    + [
        T.StructField(n, T.BooleanType())
        for n in (
            "debt_to_assets_ok",
            "interest_income_ok",
            "interest_bearing_debt_ok",
            "profitability_ok",
            "equity_ok",
        )
    ]
    + [
        T.StructField(n, T.DoubleType())
        for n in (
            "debt_to_assets_value",
            "interest_income_value",
            "interest_bearing_debt_value",
            "roa_value",
            "equity_ratio_value",
        )
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("shariah_compliant", T.IntegerType()),
        T.StructField("predicted_compliant", T.IntegerType()),
        T.StructField("compliance_probability", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("prediction_correct", T.IntegerType()),
    ]
)
