"""Company tables derived from customer, orders and lineitem.

Lines are reduced per order before they meet the orders, and orders per
customer after, so every large table is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATEMENT_YEARS = ("1995", "1996", "1997", "1998", "1999", "2000", "2001")
ACCOUNTS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    impure = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_discount") <= 0.04)
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum(net).alias("net_revenue"),
            F.sum(F.when(impure, net).otherwise(0.0)).alias("nonhalal_revenue"),
            F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice")).otherwise(0.0)).alias(
                "operating_cash_flow"
            ),
            F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("interest_expense"),
        )
    )


def _sector() -> Column:
    return F.when(F.col("c_custkey") % 50 != 0, F.col("c_mktsegment"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per company: key, name, sector and the 8 base amounts."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    lines = _order_amounts(spark, sf_dir)
    owed = F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(0.0)
    books = (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
        .groupBy("o_custkey")
        .agg(
            F.round(F.sum("o_totalprice"), 2).alias("total_assets"),
            F.round(F.sum(owed), 2).alias("total_liabilities"),
            F.round(F.sum("net_revenue"), 4).alias("net_revenue"),
            F.round(F.sum("nonhalal_revenue"), 4).alias("nonhalal_revenue"),
            F.round(F.sum("operating_cash_flow"), 2).alias("operating_cash_flow"),
            F.round(F.sum("interest_expense"), 4).alias("interest_expense"),
        )
    )
    customer = table(spark, sf_dir, "customer")
    return customer.join(books, customer.c_custkey == books.o_custkey, "left").select(
        F.col("c_custkey").alias("company_id"),
        F.col("c_custkey").cast("string").alias("symbol"),
        F.col("c_name").alias("company_name"),
        _sector().alias("sector"),
        "total_assets",
        "total_liabilities",
        F.round(F.col("total_assets") - F.lit(1.6) * F.col("total_liabilities"), 4).alias("total_equity"),
        "net_revenue",
        F.try_divide("nonhalal_revenue", "net_revenue").alias("nonhalal_revenue_percent"),
        F.round((F.col("c_acctbal") - 1000) * 100, 4).alias("net_income"),
        "operating_cash_flow",
        "interest_expense",
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long statements: one row per (symbol, account, type), one column per year."""
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate").cast("string"))
    return (
        orders.where(F.col("year").isin(*STATEMENT_YEARS))
        .groupBy(
            F.col("o_custkey").cast("string").alias("symbol"),
            F.col("o_orderpriority").alias("account"),
            F.col("o_orderstatus").alias("type"),
        )
        .pivot("year", list(STATEMENT_YEARS))
        .agg(F.round(F.sum("o_totalprice"), 2))
    )


def sector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, sector) for the companies that have a sector."""
    return (
        table(spark, sf_dir, "customer")
        .where(F.col("c_custkey") % 50 != 0)
        .select(F.col("c_custkey").cast("string").alias("symbol"), F.col("c_mktsegment").alias("sector"))
    )
