"""Rule sets, thresholds, feature order and model presets.

Values under a "fixed values" comment are part of the screening standard the
results have to agree with. Everything is plain data, so a caller can pass a
different rule set to any operator.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Added to every ratio denominator.
EPSILON = 1e-5

# --- fixed values: statement years and critical accounts --------------------
STATEMENT_YEARS = ("2020", "2021", "2022", "2023")

CRITICAL_ACCOUNTS = (
    "Total_Assets",
    "Total_Revenue",
    "Total_Debt",
    "Net_Income",
    "Total_Equity_Gross_Minority_Interest",
)

# --- fixed values: canonical amount -> accepted account names, best first ---
ACCOUNT_ALIASES = {
    "total_assets": ("Total_Assets", "Total Assets"),
    "total_liabilities": (
        "Total_Liabilities_Net_Minority_Interest",
        "Total_Liabilities",
        "Total_Debt",
        "Total Liabilities",
    ),
    "total_equity": (
        "Total_Equity_Gross_Minority_Interest",
        "Total_Equity",
        "Stockholders_Equity",
        "Common_Stock_Equity",
    ),
    "net_revenue": ("Total_Revenue", "Operating_Revenue", "Net_Revenue"),
    "nonhalal_revenue_percent": ("Nonhalal_Revenue_Percent", "nonhalal_revenue_percent"),
    "net_income": (
        "Net_Income",
        "Net_Income_Common_Stockholders",
        "Net_Income_Continuous_Operations",
    ),
    "operating_cash_flow": (
        "Operating_Cash_Flow",
        "Cash_Flowsfromusedin_Operating_Activities_Direct",
    ),
    "interest_expense": (
        "Interest_Expense",
        "Interest_Expense_Non_Operating",
        "Interest_Expense_Total",
    ),
}

# --- fixed values: feature names in model order -----------------------------
AMOUNTS = (
    "total_assets",
    "total_liabilities",
    "total_equity",
    "net_revenue",
    "nonhalal_revenue_percent",
    "net_income",
    "operating_cash_flow",
    "interest_expense",
)
RATIOS = (
    "debt_to_equity",
    "debt_to_assets",
    "roe",
    "roa",
    "profit_margin",
    "interest_coverage",
    "cash_flow_to_debt",
)
INDICATORS = ("f_riba", "f_nonhalal", "riba_intensity")
MODEL_FEATURES = AMOUNTS + RATIOS + INDICATORS + ("sector_encoded",)

INTERACTION_FEATURES = (
    "debt_service_ratio",
    "leverage_profit_interaction",
    "nonhalal_asset_ratio",
    "cashflow_debt_coverage",
    "roa_riba_efficiency",
    "equity_quality",
    "halal_revenue_strength",
    "financial_stability",
)
POLYNOMIAL_FEATURES = (
    "debt_to_assets_squared",
    "nonhalal_percent_squared",
    "profit_margin_squared",
    "interest_coverage_squared",
    "roa_squared",
)
DOMAIN_FEATURES = (
    "shariah_risk_score",
    "riba_exposure_level",
    "nonhalal_concentration",
    "compliance_capacity",
    "mixed_asset_risk",
)
SECTOR_FEATURES = ("sector_avg_debt", "sector_avg_profit", "debt_vs_sector")
STATISTICAL_FEATURES = (
    "debt_zscore",
    "nonhalal_zscore",
    "profit_zscore",
    "risk_quantile",
    "financial_health_index",
)

# --- fixed values: sector codes ----------------------------------------------
SECTOR_CODES = {
    "Agriculture": 0,
    "Banking": 1,
    "Chemicals": 2,
    "Construction": 3,
    "Food & Beverage": 4,
    "Infrastructure": 5,
    "Insurance": 6,
    "Manufacturing": 7,
    "Manufacturing, Electronics": 8,
    "Manufacturing, Food & Beverage": 9,
    "Media": 10,
    "Mining": 11,
    "Oil & Gas": 12,
    "Other": 13,
    "Pharmaceuticals": 14,
    "Real Estate": 15,
    "Retail": 16,
    "Technology": 17,
    "Telecommunications": 18,
    "Tobacco": 19,
    "Utilities": 20,
}
DEFAULT_SECTOR = "Other"

# --- fixed values: columns of a label table that are never model inputs -----
LABEL_COLUMNS = (
    "symbol",
    "sector",
    "shariah_compliant",
    "sector_compliant",
    "financial_compliant",
    "debt_to_assets_ok",
    "interest_income_ok",
    "interest_bearing_debt_ok",
    "profitability_ok",
    "equity_ok",
    "debt_to_assets_value",
    "interest_income_value",
    "interest_bearing_debt_value",
    "roa_value",
    "equity_ratio_value",
)


@dataclass(frozen=True)
class LabelRules:
    """Inclusive bounds of the labelling rule set (fixed values as defaults)."""

    prohibited_sectors: tuple[str, ...] = (
        "Tobacco",
        "Alcohol",
        "Gambling",
        "Pornography",
        "Weapons",
        "Entertainment",
    )
    debt_to_assets_max: float = 0.45
    interest_income_max: float = 0.10
    interest_bearing_debt_max: float = 0.45
    roa_min: float = -0.10
    equity_ratio_min: float = -0.20


@dataclass(frozen=True)
class ScreeningRules:
    """Strict bounds and grey zones of the three-state engine (fixed values)."""

    haram_terms: tuple[str, ...] = (
        "Alcohol",
        "Beverages",
        "Tobacco",
        "Gambling",
        "Casino",
        "Gaming",
        "Pork",
        "Pork Products",
        "Banking",
        "Conventional Banking",
        "Insurance",
        "Conventional Insurance",
        "Financial Services",
        "Credit Card",
        "Mortgage",
        "Weapons",
        "Defense",
        "Military",
        "Entertainment",
        "Cinema",
        "Music",
        "Adult Entertainment",
    )
    debt_limit: float = 0.45
    nonhalal_limit: float = 0.10
    debt_zone: tuple[float, float] = (0.40, 0.48)
    nonhalal_zone: tuple[float, float] = (0.07, 0.13)


@dataclass(frozen=True)
class Guardrails:
    """Deterministic rejections that override a model (fixed values)."""

    riba_limit: float = 0.50
    nonhalal_limit: float = 0.25
    prohibited_sectors: tuple[str, ...] = (
        "ALCOHOL",
        "WEAPONS",
        "GAMBLING",
        "PORK",
        "CONVENTIONAL_BANKING",
        "ADULT_CONTENT",
    )


@dataclass(frozen=True)
class DeploymentGuardrails:
    """Guardrails of the deployed decision (fixed values)."""

    riba_limit: float = 0.25
    debt_limit: float = 4.0
    decision_threshold: float = 0.45
    prohibited_sectors: tuple[str, ...] = (
        "Beverages (Alcohol)",
        "Tobacco",
        "Gaming",
        "Gambling",
    )


# --- fixed values: metric targets --------------------------------------------
METRIC_TARGETS = {
    "f1": 0.85,
    "precision": 0.90,
    "recall": 0.85,
    "auc": 0.92,
    "accuracy": 0.85,
    "guardrail_pass_rate": 0.80,
}

COST_FALSE_POSITIVE = 1.0
COST_FALSE_NEGATIVE = 5.0


@dataclass(frozen=True)
class BoostParams:
    """Boosted-tree settings, named after their effect.

    ``loss_reduction`` is the total gain a split must bring,
    ``min_child_weight`` the least curvature of a child, ``positive_weight`` the
    weight of label 1 relative to label 0, ``l1`` and ``l2`` the penalties of
    leaf values.
    """

    trees: int = 100
    depth: int = 5
    learning_rate: float = 0.1
    min_child_weight: int = 1
    loss_reduction: float = 0.0
    row_sample: float = 0.8
    column_sample: float = 0.8
    positive_weight: float = 1.0
    seed: int = 42
    l1: float = 0.0
    l2: float = 1.0


# --- fixed values: model presets -----------------------------------------------
PRESETS = {
    "conservative": BoostParams(
        trees=200, depth=4, learning_rate=0.01, min_child_weight=5, loss_reduction=0.5, row_sample=0.7, column_sample=0.7
    ),
    "balanced": BoostParams(
        trees=150, depth=6, learning_rate=0.01, min_child_weight=1, loss_reduction=0.3, row_sample=0.9, column_sample=0.6
    ),
    "aggressive": BoostParams(
        trees=300, depth=8, learning_rate=0.05, min_child_weight=1, loss_reduction=0.1, row_sample=1.0, column_sample=1.0
    ),
}
PRODUCTION_MODEL = BoostParams(150, 6, 0.01, 1, 0.3, 0.9, 0.6)
SCORER_MODEL = BoostParams(150, 6, 0.1, 3, 0.0, 0.8, 0.8)
EARLY_STOP_MODEL = BoostParams(200, 5, 0.05, 1, 0.0, 0.8, 0.8)


@dataclass(frozen=True)
class TuningGrids:
    """Search spaces of the staged tuner (fixed values as defaults)."""

    tree: dict = field(
        default_factory=lambda: {
            "depth": (4, 5, 6, 7, 8),
            "min_child_weight": (1, 3, 5, 7),
            "loss_reduction": (0, 0.1, 0.3, 0.5),
        }
    )
    sampling: dict = field(
        default_factory=lambda: {
            "column_sample": (0.6, 0.7, 0.8, 0.9),
            "row_sample": (0.6, 0.7, 0.8, 0.9),
        }
    )
    learning: dict = field(
        default_factory=lambda: {
            "learning_rate": (0.01, 0.05, 0.1, 0.15, 0.2),
            "trees": (100, 150, 200, 300),
        }
    )
    random: dict = field(
        default_factory=lambda: {
            "depth": (3, 4, 5, 6, 7, 8, 9, 10),
            "min_child_weight": (1, 2, 3, 4, 5, 6, 7, 8),
            "loss_reduction": (0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0),
            "row_sample": (0.5, 0.6, 0.7, 0.8, 0.9, 1.0),
            "column_sample": (0.5, 0.6, 0.7, 0.8, 0.9, 1.0),
        }
    )
    random_draws: int = 50
