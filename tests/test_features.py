import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveline import settings as S
from sieveline.operators import enrich as X
from sieveline.operators import features as P

AMOUNTS = ", ".join(f"{a} double" for a in S.AMOUNTS)


def company(**amounts):
    base = dict.fromkeys(S.AMOUNTS, 0.0)
    base.update(amounts)
    return tuple(base[a] for a in S.AMOUNTS)


@pytest.mark.parametrize(
    "ratio, amounts, expected",
    [
        ("debt_to_equity", {"total_liabilities": 100.0, "total_equity": 50.0}, 2.0),
        ("debt_to_assets", {"total_liabilities": 100.0, "total_assets": 500.0}, 0.2),
        ("roe", {"net_income": 50.0, "total_equity": 500.0}, 0.1),
        ("roa", {"net_income": 100.0, "total_assets": 1000.0}, 0.1),
        ("profit_margin", {"net_income": 50.0, "net_revenue": 500.0}, 0.1),
    ],
)
def test_documented_ratios(spark, ratio, amounts, expected):
    df = spark.createDataFrame([("A", *company(**amounts))], f"symbol string, {AMOUNTS}")
    assert P.feature_table(df).first()[ratio] == pytest.approx(expected, abs=1e-6)


def test_zero_denominator_is_huge_but_finite(spark):
    df = spark.createDataFrame([("A", *company(net_income=5.0))], f"symbol string, {AMOUNTS}")
    assert P.feature_table(df).first()["roa"] == pytest.approx(5.0 / 1e-5)


def test_bad_amounts_become_zero(spark):
    df = spark.createDataFrame(
        [("A", "n/a", float("nan")), ("B", "", float("inf")), ("C", "1e3", 2.0)],
        "symbol string, Total_Assets string, Net_Income double",
    )
    got = {r.symbol: (r.total_assets, r.net_income) for r in P.base_amounts(df).collect()}
    assert got == {"A": (0.0, 0.0), "B": (0.0, 0.0), "C": (1000.0, 2.0)}
    table = P.feature_table(df)
    assert table.columns == ["symbol", "sector", *S.MODEL_FEATURES]
    assert table.first().sector == "Other" and table.first().sector_encoded == 13
    assert [r.n for r in df.select(P.incomplete_amounts(df).alias("n")).collect()][0] == 6


def test_liabilities_fall_back_for_the_whole_table_only(spark):
    schema = "symbol string, total_liabilities double, total_debt double"
    none = spark.createDataFrame([("A", 0.0, 5.0), ("B", 0.0, None)], schema)
    some = spark.createDataFrame([("A", 0.0, 5.0), ("B", 1.0, 7.0)], schema)
    assert [r.total_liabilities for r in P.liabilities_fallback(none).orderBy("symbol").collect()] == [5.0, 0.0]
    assert [r.total_liabilities for r in P.liabilities_fallback(some).orderBy("symbol").collect()] == [0.0, 1.0]


def test_sector_codes(spark):
    df = spark.createDataFrame([("Agriculture",), ("Utilities",), (None,), ("nope",)], "sector string")
    assert [r[0] for r in df.select(P.sector_code(F.col("sector"))).collect()] == [0, 20, 13, 13]


def test_alphabetical_codes_and_unseen_sector(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "id int, sector string")
    got = {r.id: r.sector_encoded for r in P.alphabetical_sector_code(df).collect()}
    assert got == {1: 1, 2: 0, 3: 2, 4: 1}
    codes = P.sector_positions(df)
    new = spark.createDataFrame([(1, "b")], "id int, sector string")
    assert P.alphabetical_sector_code(new, codes).first().sector_encoded == 1
    unseen = spark.createDataFrame([(1, "zzz")], "id int, sector string")
    with pytest.raises(Exception, match="unseen sector"):
        P.alphabetical_sector_code(unseen, codes).collect()


def test_median_imputation_drops_rows_without_target(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 1), (2, None, 0), (3, 3.0, 1), (4, 10.0, None)], "id int, x double, y int"
    )
    got = {r.id: r.x for r in P.impute_medians(df, ["x"], "y").collect()}
    assert got == {1: 1.0, 2: 3.0, 3: 3.0}


def enriched_pandas(pdf: pd.DataFrame) -> pd.DataFrame:
    """The table-wide features by pandas."""
    out = pd.DataFrame({"symbol": pdf.symbol})
    n, d, r = pdf.nonhalal_revenue_percent, pdf.debt_to_assets, pdf.riba_intensity
    out["shariah_risk_score"] = 0.4 * d / d.max() + 0.4 * n / 100 + 0.2 * r / (r.max() + 1e-5)
    out["risk_quantile"] = out["shariah_risk_score"].rank(pct=True)
    out["sector_avg_debt"] = pdf.groupby("sector").debt_to_assets.transform("mean").fillna(0)
    out["debt_vs_sector"] = (d - pdf.groupby("sector").debt_to_assets.transform("mean")).fillna(0)
    out["debt_zscore"] = (d - d.mean()) / (d.std() + 1e-5)
    return out


def test_enriched_features_match_pandas(many_partitions):
    spark = many_partitions
    rows = []
    for i in range(60):
        debt = 30.0 if i % 3 == 0 else float(i)
        sector = None if i == 7 else ("x" if i % 4 else "y")
        rows.append((f"s{i:02d}", sector, 100.0, debt, 100.0 - debt, 50.0, (i % 5) / 20, 4.0, 9.0, (i % 3) * 1.0))
    df = spark.createDataFrame(rows, f"symbol string, sector string, {AMOUNTS}")
    table = P.with_ratios(df)
    made, names = X.enrich(table)
    assert len(names) == 45
    got = made.toPandas().sort_values("symbol").reset_index(drop=True)
    want = enriched_pandas(table.toPandas().sort_values("symbol").reset_index(drop=True))
    for c in want.columns[1:]:
        assert got[c].tolist() == pytest.approx(want[c].tolist(), abs=1e-9), c
    assert not got[names].drop(columns="sector").isna().any().any()
    assert all(math.isfinite(v) for c in X.ENGINEERED for v in got[c])


def test_enrich_adds_only_missing_ratios(spark):
    df = spark.createDataFrame([("A", "x", *company(total_assets=10.0, total_liabilities=5.0), 0.9)],
                               f"symbol string, sector string, {AMOUNTS}, debt_to_assets double")
    filled = X.fill_base_ratios(df).first()
    assert filled.debt_to_assets == 0.9 and filled.f_riba == 0.9
