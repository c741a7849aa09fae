"""Registry, shared inputs and shared SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import settings as S
from sieveline.operators.features import feature_table
from sieveline.operators.labeling import label_companies
from sieveline.plans.star_schema import companies

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# The rule sets on the test tables: the sector lists name market segments.
LABEL_RULES = S.LabelRules(prohibited_sectors=("HOUSEHOLD",))
SCREENING_RULES = S.ScreeningRules(haram_terms=("HOUSE", "Gambling"))
GUARDRAILS = S.Guardrails(prohibited_sectors=("MACHINERY",))
DEPLOYMENT = S.DeploymentGuardrails(prohibited_sectors=("MACHINERY",))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL twin where SQL can express it."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_table(companies(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_companies(features(spark, sf_dir), LABEL_RULES)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a score that is a fixed logistic function of two features.

    It stands in for a model wherever a query measures predictions, so the
    result can be checked in SQL. Two decimals make ties common.
    """
    data = features(spark, sf_dir)
    labelled = label_companies(
        data.withColumn("_p", _score()), LABEL_RULES, keep=["_p"]
    )
    p = F.col("_p")
    return labelled.select(
        F.col("symbol").cast("long").alias("company_id"),
        "symbol",
        "sector",
        F.col("shariah_compliant").alias("label"),
        p.alias("probability"),
        (p >= 0.5).cast("int").alias("prediction"),
        F.greatest(p, F.lit(1.0) - p).alias("confidence"),
    )


def _score(shift: float = 3.0, debt: float = 5.0, income: float = 8.0) -> Column:
    z = F.lit(shift) - F.lit(debt) * F.col("debt_to_assets") - F.lit(income) * F.col("f_nonhalal")
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 2)


def three_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three different scores per company, for votes and blends."""
    data = features(spark, sf_dir)
    made = data.withColumns({"p1": _score(), "p2": _score(2.0, 6.0, 2.0), "p3": _score(1.5, 1.0, 12.0)})
    labelled = label_companies(made, LABEL_RULES, keep=["p1", "p2", "p3"])
    return labelled.select(
        F.col("symbol").cast("long").alias("company_id"),
        F.col("shariah_compliant").alias("label"),
        "p1",
        "p2",
        "p3",
    )


def significant(c: str | Column) -> Column:
    """Nine significant digits: sums differ in the last bits between engines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.format_string("%.8e", c).cast("double")


def sql_significant(expr: str) -> str:
    return f"CAST(printf('%.8e', CAST({expr} AS DOUBLE)) AS DOUBLE)"


# --- SQL -----------------------------------------------------------------------

SQL_COMPANIES = """
lines AS (
  SELECT l_orderkey,
    sum(l_extendedprice * (1 - l_discount)) AS net_revenue,
    sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_discount <= 0.04
             THEN l_extendedprice * (1 - l_discount) ELSE 0 END) AS nonhalal_revenue,
    sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END) AS operating_cash_flow,
    sum(l_extendedprice * l_tax) AS interest_expense
  FROM lineitem GROUP BY l_orderkey),
books AS (
  SELECT o_custkey,
    round(sum(o_totalprice), 2) AS total_assets,
    round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS total_liabilities,
    round(sum(net_revenue), 4) AS net_revenue,
    round(sum(nonhalal_revenue), 4) AS nonhalal_revenue,
    round(sum(operating_cash_flow), 2) AS operating_cash_flow,
    round(sum(interest_expense), 4) AS interest_expense
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey GROUP BY o_custkey),
companies AS (
  SELECT c_custkey AS company_id, CAST(c_custkey AS VARCHAR) AS symbol, c_name AS company_name,
    CASE WHEN c_custkey % 50 <> 0 THEN c_mktsegment END AS sector,
    total_assets, total_liabilities,
    round(total_assets - 1.6 * total_liabilities, 4) AS total_equity,
    net_revenue, nonhalal_revenue / nullif(net_revenue, 0) AS nonhalal_revenue_percent,
    round((c_acctbal - 1000) * 100, 4) AS net_income, operating_cash_flow, interest_expense
  FROM customer LEFT JOIN books ON o_custkey = c_custkey)"""

SQL_AMOUNTS = SQL_COMPANIES + """,
amounts AS (
  SELECT company_id, symbol, company_name, sector,
    coalesce(total_assets, 0) AS total_assets, coalesce(total_liabilities, 0) AS total_liabilities,
    coalesce(total_equity, 0) AS total_equity, coalesce(net_revenue, 0) AS net_revenue,
    coalesce(nonhalal_revenue_percent, 0) AS nonhalal_revenue_percent,
    coalesce(net_income, 0) AS net_income, coalesce(operating_cash_flow, 0) AS operating_cash_flow,
    coalesce(interest_expense, 0) AS interest_expense
  FROM companies)"""

SQL_FEATURES = SQL_AMOUNTS + """,
features AS (
  SELECT *,
    coalesce(total_liabilities / nullif(total_equity + 1e-5, 0), 0) AS debt_to_equity,
    coalesce(total_liabilities / nullif(total_assets + 1e-5, 0), 0) AS debt_to_assets,
    coalesce(net_income / nullif(total_equity + 1e-5, 0), 0) AS roe,
    coalesce(net_income / nullif(total_assets + 1e-5, 0), 0) AS roa,
    coalesce(net_income / nullif(net_revenue + 1e-5, 0), 0) AS profit_margin,
    coalesce(net_income / nullif(interest_expense + 1e-5, 0), 0) AS interest_coverage,
    coalesce(operating_cash_flow / nullif(total_liabilities + 1e-5, 0), 0) AS cash_flow_to_debt,
    coalesce(total_liabilities / nullif(total_assets + 1e-5, 0), 0) AS f_riba,
    nonhalal_revenue_percent AS f_nonhalal,
    coalesce(interest_expense / nullif(net_revenue + 1e-5, 0), 0) AS riba_intensity,
    13 AS sector_encoded
  FROM amounts)"""

SQL_LABELS = SQL_FEATURES + """,
ruled AS (
  SELECT *,
    CASE WHEN sector IN ('HOUSEHOLD') THEN 0 ELSE 1 END AS sector_compliant,
    debt_to_assets <= 0.45 AS debt_to_assets_ok,
    f_nonhalal <= 0.10 AS interest_income_ok,
    f_riba <= 0.45 AS interest_bearing_debt_ok,
    roa >= -0.10 AS profitability_ok,
    total_equity / (total_assets + 1e-5) >= -0.20 AS equity_ok,
    total_equity / (total_assets + 1e-5) AS equity_ratio_value
  FROM features),
labels AS (
  SELECT *,
    CAST(debt_to_assets_ok AND interest_income_ok AND interest_bearing_debt_ok
         AND profitability_ok AND equity_ok AS INTEGER) AS financial_compliant,
    CAST(sector_compliant = 1 AND debt_to_assets_ok AND interest_income_ok AND interest_bearing_debt_ok
         AND profitability_ok AND equity_ok AS INTEGER) AS shariah_compliant
  FROM ruled)"""

SQL_SCORED = SQL_LABELS + """,
probabilities AS (
  SELECT company_id, symbol, sector, shariah_compliant AS label,
    round(1 / (1 + exp(-(3.0 - 5.0 * debt_to_assets - 8.0 * f_nonhalal))), 2) AS probability
  FROM labels),
scored AS (
  SELECT *, CAST(probability >= 0.5 AS INTEGER) AS prediction,
    greatest(probability, 1 - probability) AS confidence
  FROM probabilities)"""

SQL_COUNTS = SQL_SCORED + """,
counts AS (
  SELECT CAST(count(*) FILTER (label = 1 AND prediction = 1) AS DOUBLE) AS tp,
    CAST(count(*) FILTER (label = 0 AND prediction = 0) AS DOUBLE) AS tn,
    CAST(count(*) FILTER (label = 0 AND prediction = 1) AS DOUBLE) AS fp,
    CAST(count(*) FILTER (label = 1 AND prediction = 0) AS DOUBLE) AS fn
  FROM scored)"""

SQL_THREE = SQL_LABELS + """,
three AS (
  SELECT company_id, shariah_compliant AS label,
    round(1 / (1 + exp(-(3.0 - 5.0 * debt_to_assets - 8.0 * f_nonhalal))), 2) AS p1,
    round(1 / (1 + exp(-(2.0 - 6.0 * debt_to_assets - 2.0 * f_nonhalal))), 2) AS p2,
    round(1 / (1 + exp(-(1.5 - 1.0 * debt_to_assets - 12.0 * f_nonhalal))), 2) AS p3
  FROM labels)"""

SQL_STATEMENTS = """
cells AS (
  SELECT CAST(o_custkey AS VARCHAR) AS symbol, o_orderpriority AS account, o_orderstatus AS type,
    CAST(year(o_orderdate) AS VARCHAR) AS year, round(sum(o_totalprice), 2) AS value
  FROM orders GROUP BY ALL),
statements AS (
  SELECT symbol, account, type,
    max(value) FILTER (year = '1995') AS "1995", max(value) FILTER (year = '1996') AS "1996",
    max(value) FILTER (year = '1997') AS "1997", max(value) FILTER (year = '1998') AS "1998",
    max(value) FILTER (year = '1999') AS "1999", max(value) FILTER (year = '2000') AS "2000",
    max(value) FILTER (year = '2001') AS "2001"
  FROM cells GROUP BY ALL)"""


def with_sql(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"
