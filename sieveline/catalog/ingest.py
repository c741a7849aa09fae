"""Queries on reading, reshaping and cleaning statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.catalog.base import (
    SQL_COMPANIES,
    SQL_FEATURES,
    SQL_LABELS,
    SQL_STATEMENTS,
    features,
    labels,
    query,
    significant,
    sql_significant,
    with_sql,
)
from sieveline.operators import reshape as R
from sieveline.operators.summaries import dataset_summary
from sieveline.plans.star_schema import ACCOUNTS, STATEMENT_YEARS, companies, sector_map, statements, table
from sieveline.sources import readers, writers
from sieveline.sources.staging import stage, staged_path

# The account names of the test tables under canonical names.
ALIASES = {
    "total_assets": ("0-NONE", "1-URGENT", "2-HIGH"),
    "total_liabilities": ("3-MEDIUM", "2-HIGH"),
    "net_income": ("4-NOT_SPECIFIED", "5-LOW"),
    "5-low": ("9-NONE",),
    "operating_cash_flow": ("8-NONE",),
}
CRITICAL = ("urgent", "Low", "specified", "Total_Debt")


@query(
    "statement_profile",
    with_sql(SQL_STATEMENTS, "SELECT count(*) AS n_rows, count(DISTINCT symbol) AS n_companies FROM statements"),
)
def statement_profile(spark, sf_dir):
    return R.statement_profile(statements(spark, sf_dir))


@query(
    "statement_melt",
    with_sql(
        SQL_STATEMENTS,
        """SELECT s.symbol, s.account, s.type, y.year, c.value
FROM statements s CROSS JOIN (VALUES ('1995'), ('1996'), ('1997'), ('1998'), ('1999'), ('2000'), ('2001')) y(year)
LEFT JOIN cells c ON c.symbol = s.symbol AND c.account = s.account AND c.type = s.type AND c.year = y.year""",
    ),
)
def statement_melt(spark, sf_dir):
    return R.melt_years(statements(spark, sf_dir), STATEMENT_YEARS)


@query(
    "statement_column_names",
    with_sql(
        SQL_STATEMENTS,
        """SELECT trim(regexp_replace(account, '[^a-zA-Z0-9]', '_', 'g'), '_') || '_' || year AS column_name,
  count(value) AS n_values
FROM (SELECT s.account, y.year, c.value
  FROM statements s CROSS JOIN (VALUES ('1995'), ('1996'), ('1997'), ('1998'), ('1999'), ('2000'), ('2001')) y(year)
  LEFT JOIN cells c ON c.symbol = s.symbol AND c.account = s.account AND c.type = s.type AND c.year = y.year)
GROUP BY ALL""",
    ),
)
def statement_column_names(spark, sf_dir):
    named = R.with_year_names(R.melt_years(statements(spark, sf_dir), STATEMENT_YEARS))
    return named.groupBy("column_name").agg(F.count("value").alias("n_values"))


_WIDE = ",\n  ".join(
    f"arg_min(value, type) FILTER (account = '{a}' AND year = '{y}') AS "
    f"\"{a.replace('-', '_').replace(' ', '_')}_{y}\""
    for a in ACCOUNTS
    for y in STATEMENT_YEARS
)


@query("statement_wide_by_year", with_sql(SQL_STATEMENTS, f"SELECT symbol,\n  {_WIDE}\nFROM cells GROUP BY symbol"))
def statement_wide_by_year(spark, sf_dir):
    return R.wide_by_year(statements(spark, sf_dir), ACCOUNTS, STATEMENT_YEARS)


SQL_FOLDED = SQL_STATEMENTS + """,
folded AS (
  SELECT symbol, replace(account, ' ', '_') AS account, type, {how} AS value
  FROM cells GROUP BY ALL),
accounts AS (
  SELECT symbol, account, arg_min(value, type) AS value FROM folded GROUP BY ALL)"""
_BY_ACCOUNT = ",\n  ".join(
    f"round(max(value) FILTER (account = '{a.replace(' ', '_')}'), 4) AS \"{a.replace(' ', '_')}\"" for a in ACCOUNTS
)


def _wide_sql(how: str) -> str:
    return with_sql(SQL_FOLDED.format(how=how), f"SELECT symbol,\n  {_BY_ACCOUNT}\nFROM accounts GROUP BY symbol")


def _wide(spark, sf_dir, method):
    folded = R.aggregate_years(statements(spark, sf_dir), STATEMENT_YEARS, method)
    wide = R.wide_accounts(folded, ACCOUNTS)
    return wide.select("symbol", *[F.round(f"`{c}`", 4).alias(c) for c in wide.columns[1:]])


@query("statement_mean_by_account", _wide_sql("avg(value)"))
def statement_mean_by_account(spark, sf_dir):
    return _wide(spark, sf_dir, "mean")


@query("statement_median_by_account", _wide_sql("median(value)"))
def statement_median_by_account(spark, sf_dir):
    return _wide(spark, sf_dir, "median")


@query("statement_latest_by_account", _wide_sql("arg_max(value, year)"))
def statement_latest_by_account(spark, sf_dir):
    return _wide(spark, sf_dir, "latest")


def _accounts(spark, sf_dir):
    """One mean value per company and account, staged: its readers pass over it more than once."""
    return stage(R.company_accounts(R.aggregate_years(statements(spark, sf_dir), STATEMENT_YEARS)), "accounts")


@query(
    "sparse_company_filter",
    with_sql(
        SQL_FOLDED.format(how="avg(value)"),
        """SELECT symbol, count(*) AS accounts_present,
  round((known - count(*)) / (known + 1), 9) AS null_share
FROM accounts, (SELECT count(DISTINCT account) AS known FROM accounts)
GROUP BY symbol, known HAVING (known - count(*)) / (known + 1) < 0.5""",
    ),
)
def sparse_company_filter(spark, sf_dir):
    accounts = _accounts(spark, sf_dir)
    return R.drop_sparse(accounts, 0.5).withColumn("null_share", F.round("null_share", 9))


@query(
    "sparse_row_filter",
    with_sql(
        SQL_COMPANIES,
        """SELECT symbol, company_name, sector, total_assets, net_revenue FROM companies
WHERE (CAST(symbol IS NULL AS INT) + CAST(company_name IS NULL AS INT) + CAST(sector IS NULL AS INT)
  + CAST(total_assets IS NULL AS INT) + CAST(net_revenue IS NULL AS INT)) / 5 < 0.4""",
    ),
)
def sparse_row_filter(spark, sf_dir):
    wide = companies(spark, sf_dir).select("symbol", "company_name", "sector", "total_assets", "net_revenue")
    return R.drop_sparse_wide(wide, 0.4)


@query(
    "critical_account_check",
    with_sql(
        SQL_FOLDED.format(how="avg(value)"),
        """SELECT w.critical_account, min(a.account) AS matched_account, count(a.account) > 0 AS found
FROM (VALUES ('urgent'), ('Low'), ('specified'), ('Total_Debt')) w(critical_account)
LEFT JOIN (SELECT DISTINCT account FROM accounts) a ON contains(lower(a.account), lower(w.critical_account))
GROUP BY 1""",
    ),
)
def critical_account_check(spark, sf_dir):
    accounts = _accounts(spark, sf_dir)
    return R.critical_accounts(accounts.select("account"), CRITICAL)


_ALIAS_ROWS = ", ".join(f"('{c}', '{a}', {i})" for c, names in ALIASES.items() for i, a in enumerate(names))
_ALIAS_LAST = ", ".join(f"('{c}', {len(names)})" for c, names in ALIASES.items())
SQL_ALIASES = SQL_FOLDED.format(how="avg(value)") + f""",
known AS (SELECT DISTINCT account FROM accounts),
hits AS (
  SELECT a.canonical, a.priority, k.account FROM (VALUES {_ALIAS_ROWS}) a(canonical, account, priority)
  JOIN known k ON k.account = a.account
  UNION ALL
  SELECT f.canonical, f.priority, k.account FROM (VALUES {_ALIAS_LAST}) f(canonical, priority)
  JOIN known k ON lower(k.account) = lower(f.canonical)),
choice AS (
  SELECT canonical, arg_min(account, priority) AS account, min(priority) AS priority FROM hits GROUP BY canonical)"""


@query("account_alias_choice", with_sql(SQL_ALIASES, "SELECT canonical, account, priority FROM choice"))
def account_alias_choice(spark, sf_dir):
    accounts = _accounts(spark, sf_dir)
    return R.alias_choice(accounts, ALIASES)


_CANONICAL = ",\n  ".join(f"round(max(value) FILTER (canonical = '{c}'), 4) AS \"{c}\"" for c in ALIASES)


@query(
    "canonical_amounts",
    with_sql(
        SQL_ALIASES,
        f"SELECT symbol,\n  {_CANONICAL}\nFROM accounts LEFT JOIN choice USING (account) GROUP BY symbol",
    ),
)
def canonical_amounts(spark, sf_dir):
    accounts = _accounts(spark, sf_dir)
    wide = R.canonical_amounts(accounts, ALIASES)
    return wide.select("symbol", *[F.round(f"`{c}`", 4).alias(c) for c in ALIASES])


@query(
    "statement_csv_round_trip",
    with_sql(
        SQL_STATEMENTS,
        """SELECT account, type, count(*) AS n_rows, count("1997") AS n_1997,
  round(sum("1997"), 2) AS sum_1997 FROM statements GROUP BY ALL""",
    ),
)
def statement_csv_round_trip(spark, sf_dir):
    path = staged_path(spark, "statements-csv")
    writers.write_table(statements(spark, sf_dir), path, "csv")
    back = readers.read_statements(spark, path, "csv", STATEMENT_YEARS)
    return back.groupBy("account", "type").agg(
        F.count("*").alias("n_rows"),
        F.count("1997").alias("n_1997"),
        F.round(F.sum(F.col("1997").try_cast("double")), 2).alias("sum_1997"),
    )


@query(
    "feature_parquet_round_trip",
    with_sql(
        SQL_FEATURES,
        "SELECT symbol, sector, total_assets, debt_to_assets, f_nonhalal, sector_encoded FROM features",
    ),
)
def feature_parquet_round_trip(spark, sf_dir):
    path = staged_path(spark, "features")
    writers.write_table(features(spark, sf_dir), path)
    return readers.read_features(spark, path).select(
        "symbol", "sector", "total_assets", "debt_to_assets", "f_nonhalal", "sector_encoded"
    )


@query("processed_csv_round_trip", _wide_sql("avg(value)"))
def processed_csv_round_trip(spark, sf_dir):
    path = staged_path(spark, "processed-csv")
    writers.write_table(_wide(spark, sf_dir, "mean"), path, "csv")
    return readers.read_processed(spark, path, ACCOUNTS)


@query(
    "pruned_first_rows",
    """SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 10""",
)
def pruned_first_rows(spark, sf_dir):
    return readers.read_table(
        spark,
        f"{sf_dir}/customer.parquet",
        columns=["c_custkey", "c_name", "c_acctbal"],
        first=10,
        order_by=["c_custkey"],
    )


@query(
    "sector_map_load",
    """SELECT c_mktsegment AS sector, count(*) AS n_symbols FROM customer WHERE c_custkey % 50 <> 0 GROUP BY 1""",
)
def sector_map_load(spark, sf_dir):
    path = staged_path(spark, "sector-map")
    writers.write_table(sector_map(spark, sf_dir), path, "json")
    return readers.read_sector_map(spark, path).groupBy("sector").agg(F.count("*").alias("n_symbols"))


@query(
    "sector_lookup",
    """SELECT CAST(c_custkey AS VARCHAR) AS symbol,
  CASE WHEN c_custkey % 50 <> 0 THEN c_mktsegment ELSE 'Other' END AS sector FROM customer""",
)
def sector_lookup(spark, sf_dir):
    symbols = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("symbol"))
    return R.attach_sector(symbols, sector_map(spark, sf_dir))


@query(
    "labels_with_features",
    with_sql(
        SQL_LABELS,
        """SELECT symbol, shariah_compliant, total_assets, debt_to_assets, f_nonhalal, roa, sector_encoded,
  19 AS n_features FROM labels""",
    ),
)
def labels_with_features(spark, sf_dir):
    joined, inputs = readers.labeled_features(labels(spark, sf_dir), features(spark, sf_dir))
    return joined.select(
        "symbol",
        "shariah_compliant",
        "total_assets",
        "debt_to_assets",
        "f_nonhalal",
        "roa",
        "sector_encoded",
        F.lit(len(inputs)).alias("n_features"),
    )


@query(
    "dataset_summary",
    with_sql(
        SQL_STATEMENTS,
        """SELECT 'statements' AS dataset, count(*) AS n_rows, 10 AS n_columns, count(DISTINCT symbol) AS n_companies,
  '1995-2001' AS period FROM statements
UNION ALL
SELECT 'features', count(*), 21, count(DISTINCT c_custkey), NULL FROM customer
UNION ALL
SELECT 'labels', count(*), 15, count(DISTINCT c_custkey), NULL FROM customer""",
    ),
)
def datasets(spark, sf_dir):
    parts = {
        "statements": statements(spark, sf_dir),
        "features": features(spark, sf_dir),
        "labels": labels(spark, sf_dir),
    }
    rows = [dataset_summary(df, name) for name, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "amount_parsing",
    with_sql(
        SQL_STATEMENTS,
        f"""SELECT account, count(try_cast(t AS DOUBLE)) AS n_numbers, count(*) - count(try_cast(t AS DOUBLE)) AS n_bad,
  {sql_significant("sum(try_cast(t AS DOUBLE))")} AS total
FROM (SELECT account, CASE WHEN type = 'P' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS t FROM cells)
GROUP BY account""",
    ),
)
def amount_parsing(spark, sf_dir):
    melted = R.melt_years(statements(spark, sf_dir), STATEMENT_YEARS).where(F.col("value").isNotNull())
    text = F.when(F.col("type") == "P", "n/a").otherwise(F.col("value").cast("string"))
    parsed = melted.withColumn("amount", R.to_amount(text))
    return parsed.groupBy("account").agg(
        F.count("amount").alias("n_numbers"),
        F.count_if(F.col("amount").isNull()).alias("n_bad"),
        significant(F.sum("amount")).alias("total"),
    )


@query(
    "sector_dictionary",
    """SELECT CAST(c_custkey AS VARCHAR) AS symbol, CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment || ', "' || c_custkey || '" {x}' ELSE c_mktsegment END
  AS sector FROM customer WHERE c_custkey % 50 <> 0""",
)
def sector_dictionary(spark, sf_dir):
    """One JSON object in one file, read back in parts; some sectors hold commas, quotation marks and braces."""
    pairs = sector_map(spark, sf_dir)
    odd = F.concat("sector", F.lit(', "'), "symbol", F.lit('" {x}'))
    named = pairs.select("symbol", F.when(F.col("symbol").cast("long") % 7 == 0, odd).otherwise(F.col("sector")).alias("sector"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    lines = named.select(F.lit(1).alias("at"), F.concat(quoted("symbol"), F.lit(": "), quoted("sector"), F.lit(",")).alias("value"))
    ends = spark.createDataFrame([(0, "{"), (2, '"last": "Other"}')], "at int, value string")
    path = staged_path(spark, "sector-dictionary")
    lines.union(ends).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    return readers.read_sector_dictionary(spark, path).where("symbol <> 'last'")


@query(
    "report_round_trip",
    """SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 6) AS mean_balance, CAST(NULL AS VARCHAR) AS note
  FROM customer GROUP BY 1""",
)
def report_round_trip(spark, sf_dir):
    """Report rows written as JSON lines, nulls kept, and read back."""
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean_balance"), F.lit(None).cast("string").alias("note")
    )
    path = staged_path(spark, "report")
    writers.write_report(rows, path)
    return spark.read.schema(rows.schema).json(path)
