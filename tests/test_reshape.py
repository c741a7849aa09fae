import pytest
from pyspark.sql import functions as F

from sieveline.operators import reshape as R
from sieveline.plans.jobs import companies_from_statements, labels_from_statements

YEARS = ("2020", "2021", "2022", "2023")
SCHEMA = "symbol string, account string, type string, `2020` string, `2021` string, `2022` string, `2023` string"


@pytest.fixture
def statements(spark):
    rows = [
        ("A", "Total Assets", "BS", "100", "200", "300", "400"),
        ("A", "Total Debt", "BS", "10", None, "n/a", "30"),
        ("A", "Net Income", "IS", "", "", "", ""),
        ("A", "Net Income", "CF", "1e3", None, None, None),
        ("B", "Total Assets", "BS", None, "50", None, "NaN"),
        ("C", "Net Income", "IS", None, None, None, None),
        ("B", "Equity (Gross)", "BS", "1", "2", "10", None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def values(df):
    return {(r.symbol, r.account): r.value for r in df.collect()}


def test_melt_keeps_every_cell(statements):
    assert R.melt_years(statements, YEARS).count() == 28


def test_year_names(spark):
    df = spark.createDataFrame([("(Total) Assets!", "2020")], "account string, year string")
    assert R.with_year_names(df).first().column_name == "Total__Assets_2020"


@pytest.mark.parametrize(
    "method, assets, debt, equity",
    [("mean", 250.0, 20.0, 13 / 3), ("median", 250.0, 20.0, 2.0), ("latest", 400.0, 30.0, 10.0), ("?", 250.0, 20.0, 13 / 3)],
)
def test_yearly_aggregates_skip_bad_values(statements, method, assets, debt, equity):
    got = values(R.company_accounts(R.aggregate_years(statements, YEARS, method)))
    assert got[("A", "Total_Assets")] == assets
    assert got[("A", "Total_Debt")] == debt
    assert got[("B", "Equity_Gross")] == pytest.approx(equity)
    assert got[("A", "Net_Income")] == 1000.0
    assert got[("B", "Total_Assets")] == 50.0
    assert "C" not in {s for s, _ in got}


def test_first_value_goes_by_ordinal(spark):
    df = spark.createDataFrame(
        [("A", "x", "IS", 1.0), ("A", "x", "BS", None), ("A", "x", "CF", 7.0)],
        "symbol string, account string, type string, value double",
    )
    assert values(R.company_accounts(df)) == {("A", "x"): 7.0}


def test_wide_has_the_given_columns(statements):
    wide = R.wide_accounts(R.aggregate_years(statements, YEARS), ["Total Assets", "Equity (Gross)"])
    assert wide.columns == ["symbol", "Total_Assets", "Equity_Gross"]
    assert wide.count() == 2


def test_wide_columns_from_the_data(statements):
    wide = R.wide_accounts(R.aggregate_years(statements, YEARS))
    assert wide.columns == ["symbol", "Equity_Gross", "Net_Income", "Total_Assets", "Total_Debt"]
    by_year = R.wide_by_year(statements)
    assert "Net_Income_2020" in by_year.columns and "Net_Income_2021" not in by_year.columns
    assert by_year.where("symbol = 'A'").first()["Equity__Gross_2020"] is None
    with pytest.raises(ValueError):
        R.column_names(statements.select("account"), limit=2)


def test_sparse_filter_is_strict(spark):
    rows = [("A", f"a{i}", 1.0) for i in range(5)] + [("B", f"a{i}", 1.0) for i in range(2)]
    df = spark.createDataFrame(rows, "symbol string, account string, value double")
    kept = {r.symbol: r.null_share for r in R.drop_sparse(df, 0.5).collect()}
    assert kept == {"A": 0.0}
    assert {r.symbol for r in R.drop_sparse(df, 0.51).collect()} == {"A", "B"}
    wide = df.groupBy("symbol").pivot("account", [f"a{i}" for i in range(5)]).agg(F.first("value"))
    assert {r.symbol for r in R.drop_sparse_wide(wide, 0.5).collect()} == {"A"}


def test_critical_accounts_match_substrings(spark):
    df = spark.createDataFrame([("Z_total_assets_net",), ("Total_Assets",), ("Net_Income",)], "account string")
    got = {r.critical_account: r.matched_account for r in R.critical_accounts(df).collect()}
    assert got["Total_Assets"] == "Total_Assets"
    assert got["Net_Income"] == "Net_Income"
    assert got["Total_Debt"] is None


def test_alias_needs_presence_anywhere_not_in_the_row(spark):
    rows = [("A", "Total_Revenue", 1.0), ("B", "Net_Revenue", 9.0), ("B", "NET_INCOME", 3.0)]
    df = spark.createDataFrame(rows, "symbol string, account string, value double")
    choice = {r.canonical: r.account for r in R.alias_choice(df).collect()}
    assert choice == {"net_revenue": "Total_Revenue", "net_income": "NET_INCOME"}
    wide = {r.symbol: r for r in R.canonical_amounts(df).collect()}
    assert (wide["B"].net_income, wide["B"].net_revenue) == (3.0, None)
    assert R.alias_columns(["symbol", "Net_Revenue", "Total_Revenue", "ROA", "total_ASSETS"])["net_revenue"] == "Total_Revenue"
    assert R.alias_columns(["total_ASSETS"])["total_assets"] == "total_ASSETS"


def test_statements_to_labels(spark):
    rows = []
    for symbol, debt in (("A", "30"), ("B", "60"), ("C", "30")):
        for account, value in (
            ("Total Assets", "100"),
            ("Total Liabilities Net Minority Interest", debt),
            ("Total Equity Gross Minority Interest", "70"),
            ("Total Revenue", "50"),
            ("Net Income", "5"),
        ):
            rows.append((symbol, account, "BS", value, value, value, value))
    rows.append(("D", "Total Assets", "BS", "1", None, None, None))
    statements = spark.createDataFrame(rows, SCHEMA)
    sectors = spark.createDataFrame([("C", "Tobacco")], "symbol string, sector string")
    companies = companies_from_statements(statements)
    assert {r.symbol for r in companies.collect()} == {"A", "B", "C"}
    features, labels = labels_from_statements(statements, sectors)
    got = {r.symbol: (r.sector, r.shariah_compliant) for r in labels.collect()}
    assert got == {"A": ("Other", 1), "B": ("Other", 0), "C": ("Tobacco", 0)}
    assert {r.symbol: r.sector_encoded for r in features.collect()} == {"A": 13, "B": 13, "C": 19}
    legacy, legacy_labels = labels_from_statements(statements, sectors, legacy_sector=True)
    assert {r.sector_encoded for r in legacy.collect()} == {13}
    assert {r.symbol: r.shariah_compliant for r in legacy_labels.collect()} == {"A": 1, "B": 0, "C": 0}
