"""Counts, distributions and top-k lists of labels and predictions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.expressions import unit_hash
from sieveline.operators.labeling import RULE_FLAGS
from sieveline.operators.ranking import exact_quantiles, long_values

BANDS = ("50-60%", "60-70%", "70-80%", "80-90%", "90-100%")


def label_summary(labels: DataFrame, label: str = "shariah_compliant") -> DataFrame:
    y = F.col(label)
    return labels.agg(
        F.count("*").alias("total_companies"),
        F.sum(y).alias("compliant"),
        (F.count("*") - F.sum(y)).alias("non_compliant"),
        (F.avg(y.cast("double")) * 100).alias("compliant_pct"),
    )


def by_sector(labels: DataFrame, label: str = "shariah_compliant", total: bool = False) -> DataFrame:
    """Companies, compliant ones and their share per sector, optionally with a total row."""
    grouped = labels.rollup("sector") if total else labels.groupBy("sector")
    out = grouped.agg(
        F.count("*").alias("n_companies"),
        F.sum(label).alias("n_compliant"),
        F.avg(F.col(label).cast("double")).alias("compliant_share"),
        *([F.grouping("sector").cast("int").alias("is_total")] if total else []),
    )
    return out


def failure_reasons(labels: DataFrame) -> DataFrame:
    """How many companies fail each rule; one company may fail several."""
    flags = {"sector": F.col("sector_compliant") == 1, **{f: F.col(f) for f in RULE_FLAGS}}
    sums = labels.agg(*[F.count_if(~ok).alias(name) for name, ok in flags.items()])
    return sums.unpivot([], list(flags), "rule", "n_failed")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and share per value."""
    total = df.agg(F.count("*")).scalar()
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.try_divide(F.col("n").cast("double"), total.cast("double")))


def describe(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """count, mean, sample std, min, quartiles and max per column.

    Exact quartiles sort the distinct values of all columns. ``approximate``
    takes them from a sketch in the same single pass as the rest.
    """
    long = long_values(df, columns)
    basic = [
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ]
    shares = [0.25, 0.5, 0.75]
    if approximate:
        sketch = long.groupBy("feature").agg(*basic, F.percentile_approx("value", shares).alias("q"))
        marks = [F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q25", "q50", "q75"))]
        return sketch.select("*", *marks).drop("q")
    quartiles = (
        exact_quantiles(df, columns, shares)
        .groupBy("feature")
        .pivot("share", shares)
        .agg(F.first("quantile"))
        .toDF("feature", "q25", "q50", "q75")
    )
    return long.groupBy("feature").agg(*basic).join(quartiles, "feature")


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column and their share."""
    names = list(columns or df.columns)
    sums = df.agg(
        F.count("*").alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in names]
    )
    out = sums.unpivot(["_n"], names, "column_name", "n_missing")
    return out.select(
        "column_name",
        "n_missing",
        F.try_divide(F.col("n_missing").cast("double"), F.col("_n").cast("double")).alias("missing_share"),
    )


def prediction_statistics(
    df: DataFrame, prediction: str = "predicted_compliant", confidence: str = "confidence"
) -> DataFrame:
    """Class counts and the distribution of the confidence, exact quartiles."""
    p, c = F.col(prediction), F.col(confidence)
    basic = df.agg(
        F.count("*").alias("total_predictions"),
        F.count_if(p == 1).alias("compliant_count"),
        F.count_if(p == 0).alias("non_compliant_count"),
        F.avg((p == 1).cast("double")).alias("compliant_share"),
        F.avg(c).alias("mean"),
        F.stddev_pop(c).alias("std_dev"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    )
    marks = exact_quantiles(df, [confidence], [0.25, 0.5, 0.75])
    table = marks.agg(F.map_from_entries(F.collect_list(F.struct("share", "quantile")))).scalar()
    return (
        basic.withColumn("_q", table)
        .withColumns(
            {
                "p25": F.try_element_at("_q", F.lit(0.25)),
                "median": F.try_element_at("_q", F.lit(0.5)),
                "p75": F.try_element_at("_q", F.lit(0.75)),
            }
        )
        .drop("_q")
    )


def confidence_band(c: str | Column = "confidence", right_closed: bool = False) -> Column:
    """The ten-point band of a confidence; null outside 0.5 to 1.

    Left-closed bands put 0.6 into 60-70% and everything from 0.9 into the
    last one. Right-closed bands put 0.6 into 50-60% and leave 0.5 out.
    """
    v = F.col(c) if isinstance(c, str) else c
    edges = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
    out = F.when(F.lit(False), "")
    for i, name in enumerate(BANDS):
        low, high = edges[i], edges[i + 1]
        if right_closed:
            inside = (v > low) & (v <= high)
        else:
            inside = (v >= low) & ((v < high) if i < 4 else F.lit(True))
        out = out.when(inside, name)
    return out


def confidence_histogram(df: DataFrame, confidence: str = "confidence", right_closed: bool = False) -> DataFrame:
    """Rows per band, empty bands as 0."""
    band = confidence_band(confidence, right_closed)
    sums = df.agg(*[F.count_if(band == name).alias(name) for name in BANDS])
    return sums.unpivot([], list(BANDS), "band", "n")


def most_confident(df: DataFrame, k: int = 15, key: str = "symbol") -> DataFrame:
    """The k predicted compliant companies with the highest confidence."""
    yes = df.where(F.col("predicted_compliant") == 1)
    return yes.orderBy(F.desc("confidence"), key).limit(k).select(key, "confidence")


def least_confident_rejections(df: DataFrame, k: int = 15, key: str = "symbol") -> DataFrame:
    """The k predicted non-compliant companies with the lowest confidence."""
    no = df.where(F.col("predicted_compliant") == 0)
    low = no.orderBy(F.asc("confidence"), key).limit(k)
    return low.select(key, "confidence", (F.lit(1.0) - F.col("confidence")).alias("risk_score"))


def preview(df: DataFrame, k: int = 10, key: str = "symbol") -> DataFrame:
    return df.orderBy(key).limit(k)


def extreme_probabilities(
    df: DataFrame, k: int = 10, probability: str = "probability", key: str = "symbol"
) -> DataFrame:
    """The k highest and the k lowest probabilities."""
    high = df.orderBy(F.desc(probability), key).limit(k).select(F.lit("highest").alias("side"), key, probability)
    low = df.orderBy(F.asc(probability), key).limit(k).select(F.lit("lowest").alias("side"), key, probability)
    return high.unionByName(low)


def exemplars(
    df: DataFrame,
    key: str = "company_id",
    label: str = "label",
    prediction: str = "prediction",
    confidence: str = "confidence",
) -> DataFrame:
    """The first correct row of each class and the least confident row."""
    right = F.col(label) == F.col(prediction)
    picks = df.agg(
        F.min(F.when(right & (F.col(prediction) == 1), F.col(key))).alias("correct_compliant"),
        F.min(F.when(right & (F.col(prediction) == 0), F.col(key))).alias("correct_non_compliant"),
        F.min_by(F.col(key), F.struct(F.col(confidence), F.col(key))).alias("least_confident"),
    )
    return picks.unpivot([], picks.columns, "example", key)


def dataset_summary(df: DataFrame, name: str, key: str = "symbol") -> DataFrame:
    """Rows, columns, distinct companies and the span of the year columns of a table."""
    years = sorted(c for c in df.columns if re.fullmatch("[0-9]{4}", c))
    period = F.lit(f"{years[0]}-{years[-1]}" if years else None).cast("string")
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_companies")).select(
        F.lit(name).alias("dataset"),
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        "n_companies",
        period.alias("period"),
    )


def standardise(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std, fitted on ``fit_on``; constant columns give 0."""
    source = fit_on if fit_on is not None else df
    stats = source.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
        )
    ).scalar()
    scaled = {
        c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_stats.m_{c}"), F.col(f"_stats.s_{c}")), F.lit(0.0))
        for c in columns
    }
    return df.withColumn("_stats", stats).withColumns(scaled).drop("_stats")


def sampled(df: DataFrame, share: float, key: str, seed: int = 42) -> DataFrame:
    """The rows whose key hashes below ``share``; smaller shares are subsets."""
    return df.where(unit_hash(key, seed) < share)
