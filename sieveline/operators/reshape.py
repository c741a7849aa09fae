"""Long statements to one row per company.

The fact table (symbol, account, type, year, value) is the main model. Wide
forms are made from it with an explicit column list, so a pivot never needs an
extra job to find its columns.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import settings as S
from sieveline.functions.expressions import account_year_name, plain_account, plain_account_py, to_amount


def melt_years(statements: DataFrame, years: Sequence[str] = S.STATEMENT_YEARS) -> DataFrame:
    """One row per (symbol, account, type, year), the raw value kept as is."""
    return statements.unpivot(["symbol", "account", "type"], list(years), "year", "value")


def with_year_names(melted: DataFrame) -> DataFrame:
    """Add the clean ``account_year`` name of every cell."""
    return melted.withColumn("column_name", account_year_name("account", "year"))


def first_value(value: str, ordinal: str) -> Column:
    """The non-null value with the smallest ordinal, whatever the row order."""
    present = F.col(value).isNotNull()
    return F.min_by(F.when(present, F.col(value)), F.when(present, F.col(ordinal)))


def column_names(names: DataFrame, limit: int = 10000) -> list[str]:
    """The distinct values of a one-column table, sorted, as future column names.

    A schema has to be known when the plan is made, so the names come to the
    driver; more than ``limit`` of them is an error.
    """
    found = [r[0] for r in names.distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} columns")
    return sorted(found)


def wide_by_year(
    statements: DataFrame,
    accounts: Sequence[str] | None = None,
    years: Sequence[str] = S.STATEMENT_YEARS,
    ordinal: str = "type",
) -> DataFrame:
    """One column per account and year, first non-null value in ordinal order.

    ``accounts`` are raw names; without them the columns are those that hold
    any value. Statement type is not part of the column, so equal names of two
    types collide and the smaller ordinal wins.
    """
    cells = with_year_names(melt_years(statements, years)).withColumn("value", to_amount("value"))
    cells = cells.where(F.col("value").isNotNull())
    if accounts is None:
        columns = column_names(cells.select("column_name"))
    else:
        clean = [re.sub("[^a-zA-Z0-9]", "_", a).strip("_") for a in accounts]
        columns = sorted({f"{a}_{y}" for a in clean for y in years})
    return (
        cells.groupBy("symbol")
        .pivot("column_name", columns)
        .agg(first_value("value", ordinal))
    )


def yearly_aggregate(years: Sequence[str], method: str = "mean") -> Column:
    """One value over the year columns of a row, nulls skipped.

    ``mean``, ``median`` or ``latest``; any other name means ``mean``. Works on
    an array built from the row, so nothing is shuffled.
    """
    present = F.filter(F.array(*[to_amount(y) for y in years]), lambda v: v.isNotNull())
    n = F.size(present)
    if method == "latest":
        return F.coalesce(*[to_amount(y) for y in reversed(list(years))])
    if method == "median":
        ordered = F.array_sort(present)
        low = F.get(ordered, F.floor((n - 1) / F.lit(2)).cast("int"))
        high = F.get(ordered, F.floor(n / F.lit(2)).cast("int"))
        return (low + high) / F.lit(2.0)
    total = F.aggregate(present, F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(total, n.cast("double"))


def aggregate_years(
    statements: DataFrame, years: Sequence[str] = S.STATEMENT_YEARS, method: str = "mean"
) -> DataFrame:
    """Statements with their years folded into one ``value``; empty rows vanish."""
    kept = [c for c in statements.columns if c not in years]
    folded = statements.select(*kept, yearly_aggregate(years, method).alias("value"))
    return folded.where(F.col("value").isNotNull())


def company_accounts(folded: DataFrame, ordinal: str = "type") -> DataFrame:
    """One row per (symbol, account) with the first value, names cleaned."""
    named = folded.withColumn("account", plain_account("account"))
    return named.groupBy("symbol", "account").agg(first_value("value", ordinal).alias("value"))


def wide_accounts(
    folded: DataFrame, accounts: Sequence[str] | None = None, ordinal: str = "type"
) -> DataFrame:
    """One row per company, one column per account.

    Without ``accounts`` the columns are the accounts that hold any value.
    """
    named = folded.withColumn("account", plain_account("account"))
    if accounts is None:
        columns = column_names(named.where(F.col("value").isNotNull()).select("account"))
    else:
        columns = [plain_account_py(a) for a in accounts]
    return named.groupBy("symbol").pivot("account", columns).agg(first_value("value", ordinal))


def drop_sparse_wide(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Keep rows whose share of null columns is below ``threshold``."""
    nulls = sum((F.col(f"`{c}`").isNull().cast("int") for c in df.columns), F.lit(0))
    return df.where(nulls / F.lit(len(df.columns)) < threshold)


def drop_sparse(accounts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The same filter on (symbol, account, value) rows, without a pivot.

    A company's null share is the accounts it lacks over all accounts plus the
    symbol column. Returns the kept symbols with that share.
    """
    present = accounts.where(F.col("value").isNotNull())
    known = present.agg(F.count_distinct("account")).scalar()
    held = present.select("symbol", "account").distinct().groupBy("symbol").agg(
        F.count("*").alias("accounts_present")
    )
    share = (known - F.col("accounts_present")) / (known + F.lit(1))
    return held.withColumn("null_share", share).where(F.col("null_share") < threshold)


def critical_accounts(
    accounts: DataFrame, wanted: Sequence[str] = S.CRITICAL_ACCOUNTS
) -> DataFrame:
    """For each wanted account the first known name that contains it, any case.

    ``accounts`` has one ``account`` column. Names rank alphabetically, the
    order in which a pivot lists its columns.
    """
    low = F.lower("account")
    hits = [
        F.min(F.when(F.contains(low, F.lit(w.lower())), F.col("account"))).alias(f"hit_{i}")
        for i, w in enumerate(wanted)
    ]
    found = accounts.agg(*hits)
    pairs = F.array(
        *[
            F.struct(F.lit(w).alias("critical_account"), F.col(f"hit_{i}").alias("matched_account"))
            for i, w in enumerate(wanted)
        ]
    )
    return found.select(F.inline(pairs)).withColumn("found", F.col("matched_account").isNotNull())


def alias_columns(
    columns: Sequence[str], aliases: Mapping[str, Sequence[str]] = S.ACCOUNT_ALIASES
) -> dict[str, str | None]:
    """For a wide table: canonical name to the best existing column, or None."""
    known = set(columns)
    lowered = {c.lower(): c for c in reversed(list(columns))}
    return {
        name: next((a for a in names if a in known), lowered.get(name.lower()))
        for name, names in aliases.items()
    }


def alias_choice(
    accounts: DataFrame, aliases: Mapping[str, Sequence[str]] = S.ACCOUNT_ALIASES
) -> DataFrame:
    """For a fact table: the winning account of every canonical name.

    An alias wins by being present anywhere in the data, in list order; a
    case-insensitive match of the canonical name itself comes last. The alias
    list is a literal, so the result has at most one row per canonical name.
    """
    known = accounts.select("account")
    matches = [
        F.min(F.when(F.col("account") == alias, F.struct(F.lit(rank).alias("priority"), "account")))
        for names in aliases.values()
        for rank, alias in enumerate(names)
    ]
    fallback = [
        F.min(
            F.when(
                F.lower("account") == name.lower(),
                F.struct(F.lit(len(names)).alias("priority"), "account"),
            )
        )
        for name, names in aliases.items()
    ]
    row = known.agg(
        F.array(*matches).alias("matches"),
        F.array(*fallback).alias("fallback"),
    )
    entries, at = [], 1
    for i, (name, names) in enumerate(aliases.items()):
        own = F.slice("matches", at, len(names))
        best = F.array_min(F.array_append(own, F.get("fallback", F.lit(i))))
        entries.append(F.struct(F.lit(name).alias("canonical"), best.alias("best")))
        at += len(names)
    return (
        row.select(F.inline(F.array(*entries)))
        .where(F.col("best").isNotNull())
        .select("canonical", F.col("best.account").alias("account"), F.col("best.priority").alias("priority"))
    )


def canonical_amounts(
    accounts: DataFrame, aliases: Mapping[str, Sequence[str]] = S.ACCOUNT_ALIASES
) -> DataFrame:
    """(symbol, account, value) rows to one row per symbol with canonical columns.

    Every symbol stays, with nulls where it has no winning account. The choice
    table is bounded by the alias list, so it is broadcast.
    """
    choice = alias_choice(accounts.select("account"), aliases)
    chosen = accounts.join(F.broadcast(choice.select("canonical", "account")), "account", "left")
    return chosen.groupBy("symbol").pivot("canonical", list(aliases)).agg(F.first("value"))


def statement_profile(statements: DataFrame, approximate: bool = False) -> DataFrame:
    """Row count and number of distinct companies, the latter from a sketch if approximate."""
    distinct = F.approx_count_distinct("symbol") if approximate else F.count_distinct("symbol")
    return statements.agg(F.count("*").alias("n_rows"), distinct.alias("n_companies"))


def attach_sector(companies: DataFrame, sectors: DataFrame, default: str = S.DEFAULT_SECTOR) -> DataFrame:
    """Left join of the symbol-to-sector map, unknown symbols get ``default``.

    No broadcast hint: the map may hold a row per company. The optimizer
    broadcasts a small map and joins a large one by shuffle.
    """
    named = companies.drop("sector").join(sectors.select("symbol", "sector"), "symbol", "left")
    return named.withColumn("sector", F.coalesce("sector", F.lit(default)))
