"""Report rows: model, data, predictions and advice as one nested document."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.settings import BoostParams
from sieveline.sources.writers import as_json_rows


def model_summary(
    spark: SparkSession,
    params: BoostParams,
    features: Sequence[str],
    metrics: DataFrame,
    threshold: float = 0.5,
    name: str = "boosted-trees",
) -> DataFrame:
    """One row with the settings, the feature list and the rounded metrics."""
    rounded = metrics.select(
        F.struct(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes])
    ).scalar()
    settings = F.struct(*[F.lit(v).alias(k) for k, v in vars(params).items()])
    return spark.range(1).select(
        F.lit(name).alias("name"),
        F.lit("Binary Classification").alias("output_type"),
        settings.alias("settings"),
        F.lit(threshold).alias("decision_threshold"),
        F.lit(len(features)).alias("feature_count"),
        F.array(*[F.lit(f) for f in features]).alias("features"),
        rounded.alias("metrics"),
    )


def document(spark: SparkSession, sections: Mapping[str, DataFrame]) -> DataFrame:
    """One row with a column per section.

    A section is a small table: metrics, bands, advice. One-row tables become
    a struct, longer ones an array of structs. Never pass row-level data.
    """
    columns = []
    for name, table in sections.items():
        rows = table.select(F.struct(*table.columns).alias("r")).agg(F.collect_list("r").alias("rows"))
        columns.append(rows.scalar().alias(name))
    return spark.range(1).select(*columns)


def report_json(spark: SparkSession, sections: Mapping[str, DataFrame]) -> DataFrame:
    return as_json_rows(document(spark, sections))
