"""Queries on features, engineered features and their preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline import settings as S
from sieveline.catalog.base import (
    SQL_AMOUNTS,
    SQL_COMPANIES,
    SQL_FEATURES,
    features,
    query,
    significant,
    sql_significant,
    with_sql,
)
from sieveline.operators import enrich as X
from sieveline.operators import features as P
from sieveline.operators.summaries import describe, missing_counts, standardise, value_counts
from sieveline.plans.star_schema import companies
from sieveline.sources.staging import stage

_AMOUNTS = ", ".join(S.AMOUNTS)
_NUMERIC = S.AMOUNTS + S.RATIOS + S.INDICATORS


@query("base_amounts", with_sql(SQL_AMOUNTS, f"SELECT symbol, sector, {_AMOUNTS} FROM amounts"))
def base_amounts(spark, sf_dir):
    return P.base_amounts(companies(spark, sf_dir))


@query(
    "feature_table",
    with_sql(SQL_FEATURES, f"SELECT symbol, sector, {', '.join(S.MODEL_FEATURES)} FROM features"),
)
def feature_table(spark, sf_dir):
    return features(spark, sf_dir)


@query(
    "feature_table_default_sector",
    with_sql(SQL_FEATURES, "SELECT symbol, 'Other' AS sector, sector_encoded, debt_to_assets FROM features"),
)
def feature_table_default_sector(spark, sf_dir):
    legacy = P.feature_table(companies(spark, sf_dir), legacy_sector=True)
    return legacy.select("symbol", "sector", "sector_encoded", "debt_to_assets")


@query(
    "base_ratios",
    with_sql(SQL_FEATURES, f"SELECT symbol, {', '.join(S.RATIOS + S.INDICATORS)} FROM features"),
)
def base_ratios(spark, sf_dir):
    amounts = P.base_amounts(companies(spark, sf_dir), ["symbol"])
    return P.with_ratios(amounts).select("symbol", *S.RATIOS, *S.INDICATORS)


@query(
    "liabilities_fallback",
    with_sql(
        SQL_AMOUNTS
        + """,
marked AS (SELECT symbol, 0.0 * total_liabilities AS total_liabilities, interest_expense AS total_debt
  FROM amounts)""",
        """SELECT symbol, CASE WHEN (SELECT sum(total_liabilities) FROM marked) = 0 THEN total_debt
  ELSE total_liabilities END AS total_liabilities FROM marked""",
    ),
)
def liabilities_fallback(spark, sf_dir):
    amounts = P.base_amounts(companies(spark, sf_dir), ["symbol"])
    marked = amounts.select(
        "symbol",
        (F.lit(0.0) * F.col("total_liabilities")).alias("total_liabilities"),
        F.col("interest_expense").alias("total_debt"),
    )
    return P.liabilities_fallback(marked).select("symbol", "total_liabilities")


@query(
    "incomplete_amounts",
    with_sql(
        SQL_COMPANIES,
        "SELECT symbol, "
        + " + ".join(f"CAST({a} IS NULL AS INTEGER)" for a in S.AMOUNTS)
        + " AS n_missing FROM companies",
    ),
)
def incomplete_amounts(spark, sf_dir):
    wide = companies(spark, sf_dir)
    return wide.select("symbol", P.incomplete_amounts(wide).alias("n_missing"))


SQL_TRAINING = SQL_AMOUNTS + """,
training AS (
  SELECT a.*,
    coalesce(c.total_liabilities / nullif(c.total_equity + 1e-5, 0), 0) AS debt_to_equity,
    coalesce(c.total_liabilities / nullif(c.total_assets, 0), 0) AS debt_to_assets,
    coalesce(c.net_income / nullif(c.total_equity + 1e-5, 0), 0) AS roe,
    coalesce(c.net_income / nullif(c.total_assets, 0), 0) AS roa,
    coalesce(c.net_income / nullif(c.net_revenue + 1e-5, 0), 0) AS profit_margin,
    coalesce(c.net_income / nullif(c.interest_expense + 1e-5, 0), 0) AS interest_coverage,
    coalesce(c.operating_cash_flow / nullif(c.total_liabilities + 1e-5, 0), 0) AS cash_flow_to_debt,
    coalesce(c.interest_expense / nullif(c.net_revenue + 1e-5, 0), 0) AS riba_intensity
  FROM amounts a JOIN companies c USING (company_id))"""


@query(
    "training_features",
    with_sql(
        SQL_TRAINING,
        f"SELECT symbol, {', '.join(S.RATIOS)}, debt_to_assets AS f_riba, nonhalal_revenue_percent AS f_nonhalal, "
        "riba_intensity FROM training",
    ),
)
def training_features(spark, sf_dir):
    return P.training_features(companies(spark, sf_dir)).select("symbol", *S.RATIOS, *S.INDICATORS)


@query(
    "sector_alphabetical_code",
    with_sql(
        SQL_COMPANIES,
        """SELECT symbol, CAST(code AS INTEGER) AS sector_encoded FROM companies JOIN (
  SELECT s, dense_rank() OVER (ORDER BY s) - 1 AS code
  FROM (SELECT DISTINCT coalesce(sector, 'nan') AS s FROM companies)) ON s = coalesce(sector, 'nan')""",
    ),
)
def sector_alphabetical_code(spark, sf_dir):
    return P.alphabetical_sector_code(companies(spark, sf_dir)).select("symbol", "sector_encoded")


SQL_INTERACTIONS = """SELECT symbol,
  coalesce(interest_expense / nullif(net_income + 1e-5, 0), 0) AS debt_service_ratio,
  debt_to_equity * profit_margin AS leverage_profit_interaction,
  coalesce(net_revenue * nonhalal_revenue_percent / 100 / nullif(total_assets + 1e-5, 0), 0) AS nonhalal_asset_ratio,
  coalesce(operating_cash_flow / nullif(total_liabilities + 1e-5, 0), 0) AS cashflow_debt_coverage,
  coalesce(roa / nullif(riba_intensity + 1e-5, 0), 0) AS roa_riba_efficiency,
  coalesce(net_income / nullif(total_equity + 1e-5, 0), 0) AS equity_quality,
  coalesce(net_revenue * (1 - nonhalal_revenue_percent / 100) / nullif(total_assets + 1e-5, 0), 0)
    AS halal_revenue_strength,
  coalesce(cash_flow_to_debt * roa / nullif(debt_to_assets + 1e-5, 0), 0) AS financial_stability
FROM features"""


@query(
    "interaction_features",
    with_sql(SQL_FEATURES, SQL_INTERACTIONS),
)
def interaction_features(spark, sf_dir):
    return X.with_interactions(features(spark, sf_dir)).select("symbol", *S.INTERACTION_FEATURES)


@query(
    "squared_features",
    with_sql(
        SQL_FEATURES,
        """SELECT symbol, debt_to_assets * debt_to_assets AS debt_to_assets_squared,
  (nonhalal_revenue_percent / 100) * (nonhalal_revenue_percent / 100) AS nonhalal_percent_squared,
  profit_margin * profit_margin AS profit_margin_squared,
  greatest(0, interest_coverage) * greatest(0, interest_coverage) AS interest_coverage_squared,
  roa * roa AS roa_squared FROM features""",
    ),
)
def squared_features(spark, sf_dir):
    return X.with_squares(features(spark, sf_dir)).select("symbol", *S.POLYNOMIAL_FEATURES)


SQL_DOMAIN = SQL_FEATURES + """,
tops AS (SELECT max(debt_to_assets) AS debt, max(riba_intensity) AS riba FROM features),
domain AS (
  SELECT features.*,
    coalesce(0.4::DOUBLE * (debt_to_assets / nullif(debt, 0)) + 0.4::DOUBLE * (nonhalal_revenue_percent / 100)
      + 0.2::DOUBLE * (riba_intensity / (riba + 1e-5)), 0) AS shariah_risk_score,
    interest_expense / (total_assets + 1e-5) AS riba_exposure_level,
    nonhalal_revenue_percent / 100 * (1 - net_income / (net_revenue + 1e-5)) AS nonhalal_concentration,
    (1 - nonhalal_revenue_percent / 100) * roa AS compliance_capacity,
    debt_to_assets * nonhalal_revenue_percent / 100 AS mixed_asset_risk
  FROM features, tops)"""


@query(
    "domain_risk_features",
    with_sql(SQL_DOMAIN, f"SELECT symbol, {', '.join(S.DOMAIN_FEATURES)} FROM domain"),
)
def domain_risk_features(spark, sf_dir):
    return X.with_domain_risk(features(spark, sf_dir)).select("symbol", *S.DOMAIN_FEATURES)


@query(
    "sector_average_features",
    with_sql(
        SQL_FEATURES,
        """SELECT symbol,
  round(CASE WHEN sector IS NULL THEN 0 ELSE avg(debt_to_assets) OVER s END, 9) AS sector_avg_debt,
  CASE WHEN sector IS NULL THEN 0 ELSE """
        + sql_significant("avg(profit_margin) OVER s")
        + """ END AS sector_avg_profit,
  round(CASE WHEN sector IS NULL THEN 0 ELSE debt_to_assets - avg(debt_to_assets) OVER s END, 9) AS debt_vs_sector
FROM features WINDOW s AS (PARTITION BY sector)""",
    ),
)
def sector_average_features(spark, sf_dir):
    made = X.with_sector_averages(features(spark, sf_dir))
    return made.select(
        "symbol",
        F.round("sector_avg_debt", 9).alias("sector_avg_debt"),
        significant("sector_avg_profit").alias("sector_avg_profit"),
        F.round("debt_vs_sector", 9).alias("debt_vs_sector"),
    )


@query(
    "zscore_features",
    with_sql(
        SQL_FEATURES,
        """SELECT symbol,
  round((debt_to_assets - avg(debt_to_assets) OVER ()) / (stddev_samp(debt_to_assets) OVER () + 1e-5), 8)
    AS debt_zscore,
  round((nonhalal_revenue_percent - avg(nonhalal_revenue_percent) OVER ())
    / (stddev_samp(nonhalal_revenue_percent) OVER () + 1e-5), 8) AS nonhalal_zscore,
  round((profit_margin - avg(profit_margin) OVER ()) / (stddev_samp(profit_margin) OVER () + 1e-5), 8)
    AS profit_zscore FROM features""",
    ),
)
def zscore_features(spark, sf_dir):
    made = X.with_zscores(features(spark, sf_dir))
    return made.select("symbol", *[F.round(c, 8).alias(c) for c in X.ZSCORES])


_PCT = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0) / count(*) OVER ()"


@query(
    "risk_quantile",
    with_sql(
        SQL_DOMAIN,
        f"SELECT symbol, round({_PCT.format('shariah_risk_score')}, 9) AS risk_quantile FROM domain",
    ),
)
def risk_quantile(spark, sf_dir):
    scored = stage(X.with_domain_risk(features(spark, sf_dir)).select("symbol", "shariah_risk_score"), "risk")
    return X.with_risk_quantile(scored).select("symbol", F.round("risk_quantile", 9).alias("risk_quantile"))


@query(
    "risk_quantile_blend",
    with_sql(
        SQL_FEATURES,
        f"""SELECT symbol, round(0.4 * {_PCT.format('debt_to_assets')}
  + 0.4 * {_PCT.format('nonhalal_revenue_percent')} + 0.2 * {_PCT.format('riba_intensity')}, 9) AS risk_quantile
FROM features""",
    ),
)
def risk_quantile_blend(spark, sf_dir):
    parts = ["debt_to_assets", "nonhalal_revenue_percent", "riba_intensity"]
    slim = stage(features(spark, sf_dir).select("symbol", *parts), "rank-input")
    return X.with_risk_quantile(slim).select("symbol", F.round("risk_quantile", 9).alias("risk_quantile"))


@query(
    "health_index",
    with_sql(
        SQL_FEATURES,
        """SELECT symbol, 1 / (debt_to_assets + 1) * (1 - nonhalal_revenue_percent / 100) * (1 + greatest(0, roa))
  AS financial_health_index FROM features""",
    ),
)
def health_index(spark, sf_dir):
    return X.with_health_index(features(spark, sf_dir)).select("symbol", "financial_health_index")


_ROUNDED = {
    "sector_avg_debt": 8,
    "debt_vs_sector": 8,
    "debt_zscore": 7,
    "nonhalal_zscore": 7,
    "profit_zscore": 7,
    "risk_quantile": 8,
}
_EXACT = ("debt_service_ratio", "equity_quality", "roa_squared", "shariah_risk_score", "mixed_asset_risk")


@query(
    "enriched_features",
    with_sql(
        SQL_DOMAIN,
        f"""SELECT symbol, 45 AS n_features,
  coalesce(interest_expense / nullif(net_income + 1e-5, 0), 0) AS debt_service_ratio,
  coalesce(net_income / nullif(total_equity + 1e-5, 0), 0) AS equity_quality,
  roa * roa AS roa_squared, shariah_risk_score, mixed_asset_risk,
  round(CASE WHEN sector IS NULL THEN 0 ELSE avg(debt_to_assets) OVER s END, 8) AS sector_avg_debt,
  round(CASE WHEN sector IS NULL THEN 0 ELSE debt_to_assets - avg(debt_to_assets) OVER s END, 8) AS debt_vs_sector,
  round((debt_to_assets - avg(debt_to_assets) OVER ()) / (stddev_samp(debt_to_assets) OVER () + 1e-5), 7)
    AS debt_zscore,
  round((nonhalal_revenue_percent - avg(nonhalal_revenue_percent) OVER ())
    / (stddev_samp(nonhalal_revenue_percent) OVER () + 1e-5), 7) AS nonhalal_zscore,
  round((profit_margin - avg(profit_margin) OVER ()) / (stddev_samp(profit_margin) OVER () + 1e-5), 7)
    AS profit_zscore,
  round({_PCT.format('shariah_risk_score')}, 8) AS risk_quantile,
  1 / (debt_to_assets + 1) * (1 - nonhalal_revenue_percent / 100) * (1 + greatest(0, roa)) AS financial_health_index
FROM domain WINDOW s AS (PARTITION BY sector)""",
    ),
)
def enriched_features(spark, sf_dir):
    made, names = X.enrich(features(spark, sf_dir))
    return made.select(
        "symbol",
        F.lit(len(names)).alias("n_features"),
        *_EXACT,
        *[F.round(c, d).alias(c) for c, d in _ROUNDED.items()],
        "financial_health_index",
    )


@query(
    "numeric_columns",
    with_sql(
        SQL_COMPANIES,
        f"SELECT count(*) AS n_rows, {', '.join(f'count({a}) AS {a}' for a in S.AMOUNTS)}, "
        "count(company_id) AS company_id FROM companies",
    ),
)
def numeric_columns(spark, sf_dir):
    wide = companies(spark, sf_dir)
    return wide.agg(
        F.count("*").alias("n_rows"), *[F.count(c).alias(c) for c in P.numeric_columns(wide)]
    )


@query(
    "model_input",
    with_sql(
        SQL_AMOUNTS,
        f"SELECT symbol, {_AMOUNTS}, 0.0::DOUBLE AS roa, 0.0::DOUBLE AS sector_encoded FROM amounts",
    ),
)
def model_input(spark, sf_dir):
    filled = P.model_input(companies(spark, sf_dir), keep=["symbol"])
    return filled.select("symbol", *S.AMOUNTS, "roa", "sector_encoded")


@query(
    "median_imputation",
    with_sql(
        SQL_COMPANIES,
        """SELECT symbol,
  round(coalesce(nonhalal_revenue_percent, (SELECT median(nonhalal_revenue_percent) FROM companies)), 9)
    AS nonhalal_revenue_percent,
  round(coalesce(total_assets, (SELECT median(total_assets) FROM companies)), 3) AS total_assets
FROM companies WHERE sector IS NOT NULL""",
    ),
)
def median_imputation(spark, sf_dir):
    wide = stage(
        companies(spark, sf_dir).select("symbol", "sector", "total_assets", "nonhalal_revenue_percent"), "impute"
    )
    filled = P.impute_medians(wide, ["total_assets", "nonhalal_revenue_percent"], target="sector")
    return filled.select(
        "symbol",
        F.round("nonhalal_revenue_percent", 9).alias("nonhalal_revenue_percent"),
        F.round("total_assets", 3).alias("total_assets"),
    )


_SUMMARY = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, {sql_significant(f'avg({c})')} AS mean, "
    f"{sql_significant(f'stddev_samp({c})')} AS std, min({c}) AS min, max({c}) AS max, "
    + ", ".join(f"round(quantile_cont({c}, 0.{q}), 6) AS q{q}" for q in ("25", "50", "75"))
    + " FROM features"
    for c in _NUMERIC
)


@query("feature_summary", with_sql(SQL_FEATURES, _SUMMARY))
def feature_summary(spark, sf_dir):
    slim = stage(features(spark, sf_dir).select(*_NUMERIC), "summary-input")
    table = describe(slim, _NUMERIC)
    return table.select(
        "feature",
        "n",
        "min",
        "max",
        *[significant(c).alias(c) for c in ("mean", "std")],
        *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")],
    )


_MISSING = ("sector", *S.AMOUNTS)


@query(
    "missing_counts",
    with_sql(
        SQL_COMPANIES,
        "\nUNION ALL\n".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_missing, "
            f"round(count(*) FILTER ({c} IS NULL) / count(*), 9) AS missing_share FROM companies"
            for c in _MISSING
        ),
    ),
)
def missing(spark, sf_dir):
    table = missing_counts(companies(spark, sf_dir), _MISSING)
    return table.withColumn("missing_share", F.round("missing_share", 9))


@query(
    "sector_value_counts",
    with_sql(
        SQL_COMPANIES,
        "SELECT sector, count(*) AS n, round(count(*) / (SELECT count(*) FROM companies), 9) AS share "
        "FROM companies GROUP BY sector",
    ),
)
def sector_value_counts(spark, sf_dir):
    return value_counts(companies(spark, sf_dir), "sector").withColumn("share", F.round("share", 9))


@query(
    "standardised_features",
    with_sql(
        SQL_FEATURES,
        "SELECT symbol, "
        + ", ".join(
            f"round(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 8) AS {c}"
            for c in ("debt_to_assets", "f_nonhalal", "riba_intensity", "total_assets")
        )
        + " FROM features",
    ),
)
def standardised_features(spark, sf_dir):
    names = ["debt_to_assets", "f_nonhalal", "riba_intensity", "total_assets"]
    scaled = standardise(features(spark, sf_dir), names)
    return scaled.select("symbol", *[F.round(c, 8).alias(c) for c in names])


SEGMENT_CODES = {"AUTOMOBILE": 1, "BUILDING": 2, "HOUSEHOLD": 7, "MACHINERY": 8, "Other": 13}


@query(
    "sector_codes",
    """SELECT c_custkey AS company_id, CASE WHEN c_custkey % 50 = 0 THEN 13 WHEN c_mktsegment = 'AUTOMOBILE' THEN 1
  WHEN c_mktsegment = 'BUILDING' THEN 2 WHEN c_mktsegment = 'HOUSEHOLD' THEN 7 WHEN c_mktsegment = 'MACHINERY' THEN 8 ELSE 13 END
  AS sector_encoded FROM customer""",
)
def sector_codes(spark, sf_dir):
    """Codes of a given table; segments it doesn't name and companies without one have the default."""
    made = companies(spark, sf_dir)
    return made.select("company_id", P.sector_code(F.col("sector"), SEGMENT_CODES).alias("sector_encoded"))
