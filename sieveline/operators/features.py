"""The 19 model features and their preparation for training."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline import settings as S
from sieveline.functions.expressions import ratio, safe_divide, zero_filled
from sieveline.operators.ranking import exact_quantiles, running_counts
from sieveline.operators.reshape import alias_columns
from sieveline.sources.staging import stage

# name -> (numerator, denominator)
RATIO_PARTS = {
    "debt_to_equity": ("total_liabilities", "total_equity"),
    "debt_to_assets": ("total_liabilities", "total_assets"),
    "roe": ("net_income", "total_equity"),
    "roa": ("net_income", "total_assets"),
    "profit_margin": ("net_income", "net_revenue"),
    "interest_coverage": ("net_income", "interest_expense"),
    "cash_flow_to_debt": ("operating_cash_flow", "total_liabilities"),
    "riba_intensity": ("interest_expense", "net_revenue"),
}
# Ratios whose denominator has no epsilon in the training variant.
PLAIN_RATIOS = ("debt_to_assets", "roa")


def base_amounts(companies: DataFrame, keep: Sequence[str] = ("symbol", "sector")) -> DataFrame:
    """The 8 base amounts as doubles: aliases resolved, missing becomes 0."""
    chosen = alias_columns(companies.columns)
    amounts = [
        (zero_filled(F.col(f"`{chosen[a]}`")) if chosen[a] else F.lit(0.0)).alias(a)
        for a in S.AMOUNTS
    ]
    return companies.select(*[c for c in keep if c in companies.columns], *amounts)


def liabilities_fallback(
    amounts: DataFrame, debt: str = "total_debt", target: str = "total_liabilities"
) -> DataFrame:
    """Use ``debt`` for liabilities when liabilities add up to 0 over the whole table."""
    if debt not in amounts.columns:
        return amounts
    total = amounts.agg(F.sum(target)).scalar()
    use_debt = F.coalesce(total, F.lit(0.0)) == 0.0
    return amounts.withColumn(target, F.when(use_debt, zero_filled(debt)).otherwise(F.col(target)))


def with_ratios(amounts: DataFrame) -> DataFrame:
    """Add the 7 ratios and 3 indicators."""
    df = amounts.withColumns({n: ratio(*RATIO_PARTS[n]) for n in RATIO_PARTS})
    return df.withColumns(
        {"f_riba": F.col("debt_to_assets"), "f_nonhalal": F.col("nonhalal_revenue_percent")}
    )


def sector_code(sector: Column, codes: Mapping[str, int] = S.SECTOR_CODES, default: str = S.DEFAULT_SECTOR) -> Column:
    """Fixed code of a sector, unknown or null as the code of the default."""
    pairs = [F.lit(x) for item in codes.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), sector), F.lit(codes[default]))


def feature_table(companies: DataFrame, legacy_sector: bool = False) -> DataFrame:
    """symbol, sector and the 19 features in model order.

    The sector is used where the table has one. ``legacy_sector`` ignores it,
    so that every company is in the default sector.
    """
    # The debt column is found in any letter case, as in real statements.
    debt = next((c for c in companies.columns if c.lower() == "total_debt"), "total_debt")
    amounts = base_amounts(companies, [c for c in companies.columns if c in ("symbol", "sector", debt)])
    amounts = liabilities_fallback(amounts, debt)
    if legacy_sector or "sector" not in amounts.columns:
        amounts = amounts.withColumn("sector", F.lit(S.DEFAULT_SECTOR))
    df = with_ratios(amounts).withColumn("sector_encoded", sector_code(F.col("sector")))
    return df.select("symbol", "sector", *S.MODEL_FEATURES)


def incomplete_amounts(companies: DataFrame) -> Column:
    """How many base amounts are missing before they are filled with 0."""
    chosen = alias_columns(companies.columns)
    known = [F.col(f"`{c}`").isNull().cast("int") for c in chosen.values() if c]
    absent = sum(1 for c in chosen.values() if c is None)
    return sum(known, F.lit(absent))


def training_features(companies: DataFrame) -> DataFrame:
    """The training variant: two ratios without epsilon, everything undefined is 0."""
    parts = {
        n: safe_divide(*RATIO_PARTS[n]) if n in PLAIN_RATIOS else ratio(*RATIO_PARTS[n])
        for n in RATIO_PARTS
    }
    df = companies.withColumns(parts)
    df = df.withColumns(
        {
            "f_riba": F.col("debt_to_assets"),
            "f_nonhalal": F.coalesce("nonhalal_revenue_percent", F.lit(0.0)),
        }
    )
    return df.withColumns({a: F.coalesce(a, F.lit(0.0)) for a in S.AMOUNTS})


def sector_positions(companies: DataFrame) -> DataFrame:
    """(sector, sector_encoded): position among the sorted distinct sectors."""
    names = companies.select(F.coalesce("sector", F.lit("nan")).alias("sector")).distinct()
    ranked = running_counts(names, "sector")
    return ranked.select("sector", F.col("n_before").cast("int").alias("sector_encoded"))


def alphabetical_sector_code(companies: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Label-encode the sector alphabetically; null counts as the text ``nan``.

    Pass the ``codes`` of an earlier table to reuse them; a sector they lack
    then fails the job.
    """
    fitted = codes is None
    codes = stage(sector_positions(companies) if fitted else codes, "sector-codes")
    named = companies.withColumn("_sector", F.coalesce("sector", F.lit("nan")))
    out = named.join(codes.withColumnRenamed("sector", "_sector"), "_sector", "left")
    if not fitted:
        unseen = F.raise_error(F.concat(F.lit("unseen sector: "), F.col("_sector")))
        out = out.withColumn("sector_encoded", F.coalesce("sector_encoded", unseen.cast("int")))
    return out.drop("_sector")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def model_input(df: DataFrame, features: Sequence[str] = S.MODEL_FEATURES, keep: Sequence[str] = ()) -> DataFrame:
    """Features in model order; absent columns and nulls become 0."""
    have = set(df.columns)
    return df.select(
        *keep,
        *[
            (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in have else F.lit(0.0)).alias(f)
            for f in features
        ],
    )


def impute_medians(df: DataFrame, features: Sequence[str], target: str | None = None) -> DataFrame:
    """Fill nulls with the exact column median; drop rows without a target.

    The medians are one row per feature and come from the running counts, not
    from a per-column buffer in one task.
    """
    medians = exact_quantiles(df, features, [0.5])
    table = medians.agg(F.map_from_entries(F.collect_list(F.struct("feature", "quantile")))).scalar()
    filled = df.withColumn("_medians", table).withColumns(
        {f: F.coalesce(F.col(f).cast("double"), F.try_element_at("_medians", F.lit(f))) for f in features}
    )
    filled = filled.drop("_medians")
    return filled if target is None else filled.where(F.col(target).isNotNull())
