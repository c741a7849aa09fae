"""26 engineered features on top of the base ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import settings as S
from sieveline.functions.expressions import ratio, safe_divide
from sieveline.operators.features import PLAIN_RATIOS, RATIO_PARTS
from sieveline.operators.ranking import with_percent_rank
from sieveline.sources.staging import stage

ENGINEERED = (
    S.INTERACTION_FEATURES
    + S.POLYNOMIAL_FEATURES
    + S.DOMAIN_FEATURES
    + S.SECTOR_FEATURES
    + S.STATISTICAL_FEATURES
)
BASE_LIST = (*S.AMOUNTS, "sector", *S.RATIOS, *S.INDICATORS)


def _or_zero(c: Column) -> Column:
    """Undefined or overflowing values become 0."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def _eps(name: str) -> Column:
    return F.col(name) + F.lit(S.EPSILON)


def fill_base_ratios(df: DataFrame) -> DataFrame:
    """Add the base ratios and indicators the table does not carry yet."""
    have = set(df.columns)
    missing = {
        n: safe_divide(*RATIO_PARTS[n]) if n in PLAIN_RATIOS else ratio(*RATIO_PARTS[n])
        for n in RATIO_PARTS
        if n not in have
    }
    df = df.withColumns(missing) if missing else df
    proxies = {"f_riba": F.col("debt_to_assets"), "f_nonhalal": F.col("nonhalal_revenue_percent")}
    proxies = {n: c for n, c in proxies.items() if n not in have}
    return df.withColumns(proxies) if proxies else df


def with_interactions(df: DataFrame, scale: float = 100.0) -> DataFrame:
    """8 products and quotients of amounts and ratios.

    ``scale`` is the divisor of the non-halal percentage.
    """
    n = F.col("nonhalal_revenue_percent")
    made = {
        "debt_service_ratio": F.try_divide(F.col("interest_expense"), _eps("net_income")),
        "leverage_profit_interaction": F.col("debt_to_equity") * F.col("profit_margin"),
        "nonhalal_asset_ratio": F.try_divide(F.col("net_revenue") * n / F.lit(scale), _eps("total_assets")),
        "cashflow_debt_coverage": F.try_divide(F.col("operating_cash_flow"), _eps("total_liabilities")),
        "roa_riba_efficiency": F.try_divide(F.col("roa"), _eps("riba_intensity")),
        "equity_quality": F.try_divide(F.col("net_income"), _eps("total_equity")),
        "halal_revenue_strength": F.try_divide(
            F.col("net_revenue") * (F.lit(1.0) - n / F.lit(scale)), _eps("total_assets")
        ),
        "financial_stability": F.try_divide(
            F.col("cash_flow_to_debt") * F.col("roa"), _eps("debt_to_assets")
        ),
    }
    return df.withColumns({k: _or_zero(c) for k, c in made.items()})


def with_squares(df: DataFrame, scale: float = 100.0) -> DataFrame:
    """5 squared features; coverage is cut at 0 first."""

    def squared(c: Column) -> Column:
        return c * c

    made = {
        "debt_to_assets_squared": squared(F.col("debt_to_assets")),
        "nonhalal_percent_squared": squared(F.col("nonhalal_revenue_percent") / F.lit(scale)),
        "profit_margin_squared": squared(F.col("profit_margin")),
        "interest_coverage_squared": squared(F.greatest(F.lit(0.0), F.col("interest_coverage"))),
        "roa_squared": squared(F.col("roa")),
    }
    return df.withColumns({k: _or_zero(c) for k, c in made.items()})


def with_domain_risk(df: DataFrame, scale: float = 100.0) -> DataFrame:
    """5 risk features. The two table-wide maxima are one scalar subquery."""
    top = df.agg(
        F.struct(F.max("debt_to_assets").alias("debt"), F.max("riba_intensity").alias("riba"))
    ).scalar()
    share = F.col("nonhalal_revenue_percent") / F.lit(scale)
    debt, riba, roa = F.col("debt_to_assets"), F.col("riba_intensity"), F.col("roa")
    margin = F.try_divide(F.col("net_income"), _eps("net_revenue"))
    made = {
        "shariah_risk_score": F.lit(0.4) * F.try_divide(debt, F.col("_top.debt"))
        + F.lit(0.4) * share
        + F.lit(0.2) * F.try_divide(riba, F.col("_top.riba") + F.lit(S.EPSILON)),
        "riba_exposure_level": F.try_divide(F.col("interest_expense"), _eps("total_assets")),
        "nonhalal_concentration": share * (F.lit(1.0) - margin),
        "compliance_capacity": (F.lit(1.0) - share) * roa,
        "mixed_asset_risk": debt * F.col("nonhalal_revenue_percent") / F.lit(scale),
    }
    return df.withColumn("_top", top).withColumns({k: _or_zero(c) for k, c in made.items()}).drop("_top")


def with_sector_averages(df: DataFrame) -> DataFrame:
    """Sector means of debt and margin, and the distance to the sector.

    One sector may hold most rows, so the means are aggregated with partial
    sums and joined back instead of being a window per sector. The staged
    means tell the optimizer their size: small ones are broadcast, and a table
    with very many sectors joins by shuffle with skew splitting. Companies
    without a sector get 0.
    """
    means = stage(
        df.where(F.col("sector").isNotNull())
        .groupBy("sector")
        .agg(
            F.avg("debt_to_assets").alias("sector_avg_debt"),
            F.avg("profit_margin").alias("sector_avg_profit"),
        ),
        "sector-means",
    )
    joined = df.join(means, "sector", "left")
    gap = F.col("debt_to_assets") - F.col("sector_avg_debt")
    return joined.withColumn("debt_vs_sector", _or_zero(gap)).withColumns(
        {n: _or_zero(F.col(n)) for n in ("sector_avg_debt", "sector_avg_profit")}
    )


ZSCORES = {
    "debt_zscore": "debt_to_assets",
    "nonhalal_zscore": "nonhalal_revenue_percent",
    "profit_zscore": "profit_margin",
}


def with_zscores(df: DataFrame) -> DataFrame:
    """Distance to the table mean in sample standard deviations."""
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{n}") for n, c in ZSCORES.items()],
            *[F.stddev_samp(c).alias(f"s_{n}") for n, c in ZSCORES.items()],
        )
    ).scalar()
    made = {
        n: _or_zero(
            F.try_divide(F.col(c) - F.col(f"_stats.m_{n}"), F.col(f"_stats.s_{n}") + F.lit(S.EPSILON))
        )
        for n, c in ZSCORES.items()
    }
    return df.withColumn("_stats", stats).withColumns(made).drop("_stats")


def with_risk_quantile(df: DataFrame) -> DataFrame:
    """Average-tie percent rank of the risk score.

    Without a risk score it blends the ranks of debt, non-halal share and
    interest intensity 0.4 / 0.4 / 0.2.
    """
    if "shariah_risk_score" in df.columns:
        ranked = with_percent_rank(df, "shariah_risk_score", "risk_quantile")
        return ranked.withColumn("risk_quantile", _or_zero(F.col("risk_quantile")))
    weights = {"debt_to_assets": 0.4, "nonhalal_revenue_percent": 0.4, "riba_intensity": 0.2}
    for c in weights:
        # Staged, because every lookup reads its input twice.
        df = stage(with_percent_rank(df, c, f"_rank_{c}"), "ranked")
    blend = sum((F.lit(w) * F.col(f"_rank_{c}") for c, w in weights.items()), F.lit(0.0))
    return df.withColumn("risk_quantile", _or_zero(blend)).drop(*[f"_rank_{c}" for c in weights])


def with_health_index(df: DataFrame, scale: float = 100.0) -> DataFrame:
    share = F.col("nonhalal_revenue_percent") / F.lit(scale)
    index = (
        F.try_divide(F.lit(1.0), F.col("debt_to_assets") + F.lit(1.0))
        * (F.lit(1.0) - share)
        * (F.lit(1.0) + F.greatest(F.lit(0.0), F.col("roa")))
    )
    return df.withColumn("financial_health_index", _or_zero(index))


def enrich(df: DataFrame, scale: float = 100.0) -> tuple[DataFrame, list[str]]:
    """All five groups, with the ordered list of features present.

    The row-wise part is staged once, so the table-wide passes that follow
    read it instead of recomputing what lies above.
    """
    rowwise = with_squares(with_interactions(fill_base_ratios(df), scale), scale)
    staged = stage(with_health_index(rowwise, scale), "enrich-base")
    whole = with_sector_averages(with_zscores(with_domain_risk(staged, scale)))
    out = with_risk_quantile(whole)
    return out, [f for f in (*BASE_LIST, *ENGINEERED) if f in out.columns]
