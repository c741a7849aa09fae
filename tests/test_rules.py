import pytest
from pyspark.sql import functions as F

from sieveline import settings as S
from sieveline.operators import guardrails as G
from sieveline.operators import labeling as B
from sieveline.operators import screening as D
from sieveline.plans.jobs import screen_portfolio

SCHEMA = (
    "ticker string, company_name string, sector string, total_assets double, total_liabilities double, "
    "nonhalal_revenue_percent double, net_income double"
)


def decide(spark, sector="Mining", assets=100.0, debt=10.0, income=0.01, profit=1.0):
    df = spark.createDataFrame([("T", "T Corp", sector, assets, debt, income, profit)], SCHEMA)
    return D.screen(df).first()


# --- labels -----------------------------------------------------------------


def label(spark, **values):
    row = {"sector": "Mining", "debt_to_assets": 0.1, "f_riba": 0.1, "f_nonhalal": 0.01, "roa": 0.1, "equity_ratio": 0.5}
    row.update(values)
    schema = "symbol string, sector string, " + ", ".join(f"{k} double" for k in row if k != "sector")
    df = spark.createDataFrame([("S", *row.values())], schema)
    return B.label_companies(df).first()


def test_label_bounds_are_inclusive(spark):
    got = label(spark, debt_to_assets=0.45, f_riba=0.45, f_nonhalal=0.10, roa=-0.10, equity_ratio=-0.20)
    assert got.shariah_compliant == 1
    assert label(spark, debt_to_assets=0.4500001).debt_to_assets_ok is False
    assert label(spark, roa=-0.1000001).profitability_ok is False


def test_null_fails_its_rule(spark):
    got = label(spark, f_nonhalal=None)
    assert got.interest_income_ok is False and got.interest_income_value is None
    assert got.financial_compliant == 0


@pytest.mark.parametrize("sector, expected", [("Tobacco", 0), ("Banking", 1), ("tobacco", 1), (None, 1)])
def test_label_sector_is_exact(spark, sector, expected):
    assert label(spark, sector=sector).shariah_compliant == expected


def test_column_fallbacks(spark):
    df = spark.createDataFrame(
        [("S", "x", 0.2, 0.05, None, 10.0, 100.0, 60.0)],
        "symbol string, sector string, f_riba double, nonhalal_revenue_percent double, roa double, "
        "net_income double, total_assets double, total_equity double",
    )
    got = B.label_companies(df).first()
    assert got.debt_to_assets_value == 0.2 and got.interest_income_value == 0.05
    assert got.roa_value == pytest.approx(0.1) and got.equity_ratio_value == pytest.approx(0.6)
    assert got.shariah_compliant == 1


# --- engine -------------------------------------------------------------------


def test_engine_bounds_are_strict(spark):
    assert decide(spark, debt=45.0).violations == ["EXCESSIVE_DEBT"]
    assert decide(spark, income=0.10).violations == ["EXCESSIVE_NONHALAL"]


@pytest.mark.parametrize(
    "debt, income, status",
    [(40.0, 0.01, "EDGE_CASE"), (39.0, 0.01, "COMPLIANT"), (1.0, 0.07, "EDGE_CASE"), (1.0, 0.069, "COMPLIANT")],
)
def test_grey_zones(spark, debt, income, status):
    assert decide(spark, debt=debt, income=income).status == status


@pytest.mark.parametrize(
    "sector, banned",
    [
        (" Banking ", True),
        ("Conventional Banking", True),
        ("Food & Beverage", False),
        ("Beverages", True),
        ("Manufacturing, Food & Beverage", False),
        ("banking", False),
    ],
)
def test_haram_terms_are_substrings(spark, sector, banned):
    got = decide(spark, sector=sector)
    assert (got.violations == ["HARAM_SECTOR"]) is banned
    assert got.rules[0].passed is (not banned)


def test_null_handling(spark):
    assert decide(spark, sector=None).status == "EDGE_CASE"
    assert decide(spark, sector=None).rules[0].explanation == "Sector: nan (Permissible)"
    assert decide(spark, profit=None).status == "EDGE_CASE"
    assert decide(spark, debt=None).violations == ["EXCESSIVE_DEBT"]
    assert decide(spark, debt=None).risk_factors == ["Excessive debt exposure: nan% > 45.0%"]
    assert decide(spark, assets=0.0).violations == ["EXCESSIVE_DEBT"]
    assert decide(spark, income=None).violations == ["EXCESSIVE_NONHALAL"]


def test_trace_stops_at_the_deciding_rule(spark):
    assert len(decide(spark, sector="Gambling").rules) == 1
    assert len(decide(spark, debt=52.1).rules) == 2
    assert len(decide(spark, income=0.5).rules) == 3
    assert decide(spark, debt=52.1).risk_factors == ["Excessive debt exposure: 52.1% > 45.0%"]
    assert decide(spark, debt=52.1).rules[1].explanation == "Debt exposure 52.1% ≥ 45%"
    assert decide(spark).supporting_factors == [
        "Passes all hard Shariah rules",
        "Debt ratio: 10.0% < 45.0%",
        "Non-halal income: 1.0% < 10.0%",
    ]
    assert decide(spark, debt=41.0, income=0.08).risk_factors == [
        "Borderline debt ratio: 41.0% (warning zone: 40%-48%)",
        "Borderline non-halal income: 8.0% (warning zone: 7%-13%)",
    ]


@pytest.mark.parametrize(
    "p, confidence",
    [(0.685843288898468, 0.842921644449234), (0.8153573274612427, 0.9076786637306213)],
)
def test_hybrid_confidence(spark, p, confidence):
    df = spark.createDataFrame([("T", "T Corp", "Mining", 100.0, 41.0, 0.01, 1.0)], SCHEMA)
    scored = D.with_model_confidence(D.screen(df), F.lit(p), [("a", 0.6), ("b", 0.3), ("c", 0.06), ("d", 0.04)])
    got = scored.first()
    assert got.final_confidence == pytest.approx(confidence, abs=1e-12)
    assert got.supporting_factors == [
        "ML: a (importance: 60.0%)",
        "ML: b (importance: 30.0%)",
        "ML: c (importance: 6.0%)",
    ]
    low = D.with_model_confidence(D.screen(df), F.lit(0.5), [("a", 0.6), ("b", 0.01)]).first()
    assert low.risk_factors[-1] == "ML: a (importance: 60.0%)" and low.supporting_factors == []


def test_hard_decisions_ignore_the_model(spark):
    df = spark.createDataFrame([("T", "T Corp", "Mining", 100.0, 90.0, 0.01, 1.0)], SCHEMA)
    got = D.as_record(D.with_model_confidence(D.screen(df), F.lit(0.9))).first()
    assert got.status == "NON_COMPLIANT" and got.ml_score is None and got.final_confidence == 1.0


def test_flat_form(spark):
    df = spark.createDataFrame(
        [("A", "A", "Mining", 100.0, 1.0, 0.0, 1.0), ("B", "B", "Casino", 100.0, 1.0, 0.0, 1.0)], SCHEMA
    )
    got = {r.ticker: r.violations for r in screen_portfolio(df).collect()}
    assert got == {"A": "None", "B": "HARAM_SECTOR"}
    counts = {r.ticker: r.n_violations for r in D.violation_counts(D.screen(df)).collect()}
    assert counts == {"A": 0, "B": 1}


# --- guardrails -----------------------------------------------------------------


def test_guardrails(spark):
    df = spark.createDataFrame(
        [("PORK", 0.1, 0.1), ("x", 0.51, 0.1), ("x", 0.5, 0.25), ("x", 0.1, 0.26), (None, None, None)],
        "sector string, f_riba double, f_nonhalal double",
    )
    assert [r[0] for r in df.select(G.guardrail_decision()).collect()] == [0, 0, 1, 0, 1]
    cases = {r.case_id: (r.n_rows, r.result) for r in G.guardrail_cases(df).collect()}
    assert cases == {"TC-001": (1, "PASS"), "TC-002": (1, "PASS"), "TC-003": (1, "PASS")}


def test_empty_guardrail_case_fails(spark):
    df = spark.createDataFrame([("x", 0.1, 0.1)], "sector string, f_riba double, f_nonhalal double")
    assert {(r.rejection_rate, r.result) for r in G.guardrail_cases(df).collect()} == {(0.0, "FAIL")}


def test_guarded_decision(spark):
    df = spark.createDataFrame(
        [("x", 0.9, 0.1, 1.0), ("x", 0.9, 0.3, 1.0), ("x", 0.9, 0.1, 4.1), ("Gaming", 0.9, 0.1, 1.0), ("x", 0.44, 0.1, 1.0)],
        "sector string, probability double, riba_intensity double, debt_to_equity double",
    )
    guarded = G.guarded_decision(df)
    assert [r.final_decision for r in guarded.collect()] == [1, 0, 0, 0, 0]
    assert G.guardrail_pass_rate(guarded).first()[0] == pytest.approx(0.4)


def test_tiers_and_targets(spark):
    df = spark.createDataFrame([(0.81,), (0.80,), (0.45,), (0.44,)], "probability double")
    assert [r[0] for r in df.select(G.probability_tier()).collect()] == [
        "compliant", "borderline", "borderline", "non_compliant",
    ]
    status = spark.createDataFrame([(0.86,), (0.85,), (0.70,)], "confidence double")
    assert [r[0] for r in status.select(G.confidence_status()).collect()] == ["High", "Medium", "Low"]
    metrics = spark.createDataFrame([("f1", 0.85), ("auc", 0.91), ("other", 1.0)], "metric string, value double")
    assert {r.metric: r.met for r in G.check_targets(metrics).collect()} == {"f1": True, "auc": False}
    assert S.METRIC_TARGETS["precision"] == 0.90


def test_recommendations(spark):
    def advice(accuracy, auc, share):
        df = spark.createDataFrame([(accuracy, auc, share)], "accuracy double, auc double, compliant_share double")
        return {r.category: r.status for r in G.recommendations(df).collect()}

    assert advice(0.92, 0.93, 0.5)["Performance"] == "EXCELLENT"
    assert advice(0.85, 0.5, 0.1) == {
        "Performance": "GOOD", "Data Balance": "IMBALANCED", "Deployment": "NOTE",
        "Monitoring": "NOTE", "Updates": "NOTE",
    }
    assert advice(0.5, 0.95, 0.3)["Confidence"] == "HIGH"


NAN = float("nan")


def test_nan_fails_label_rules_like_null(spark):
    from sieveline.operators.labeling import with_financial_rules

    cols = "debt_to_assets double, f_riba double, f_nonhalal double, roa double, equity_ratio double"
    df = spark.createDataFrame([(0.1, 0.1, 0.0, NAN, NAN), (0.1, 0.1, 0.0, 0.1, 0.5), (NAN, NAN, NAN, 0.1, 0.5)], cols)
    got = [(r.profitability_ok, r.equity_ok, r.debt_to_assets_ok, r.financial_compliant) for r in with_financial_rules(df).collect()]
    assert got == [(False, False, True, 0), (True, True, True, 1), (True, True, False, 0)]


def test_nan_is_not_above_a_guardrail_or_tier(spark):
    df = spark.createDataFrame([("OTHER", NAN, NAN), ("OTHER", 0.9, 0.0)], "sector string, f_riba double, f_nonhalal double")
    assert [r[0] for r in df.select(G.guardrail_decision()).collect()] == [1, 0]
    tiers = spark.createDataFrame([(NAN,), (0.9,)], "probability double").select(G.probability_tier())
    assert [r[0] for r in tiers.collect()] == ["non_compliant", "compliant"]


def test_companies_without_an_alias_and_the_debt_fallback(spark):
    from sieveline.operators.features import feature_table
    from sieveline.operators.reshape import canonical_amounts

    accounts = spark.createDataFrame([("a", "Total_Assets", 5.0), ("b", "Unknown", 1.0)], "symbol string, account string, value double")
    assert {r.symbol: r.total_assets for r in canonical_amounts(accounts).collect()} == {"a": 5.0, "b": None}
    companies = spark.createDataFrame([("a", 100.0, 0.0, 40.0)], "symbol string, total_assets double, total_liabilities double, Total_Debt double")
    assert feature_table(companies).first().total_liabilities == 40.0
