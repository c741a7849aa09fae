"""Screening of arriving portfolio files.

The rules are stateless projections, so the batch plan also runs on a
streaming input: no state, no watermark, each row decided when it arrives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sieveline import settings as S
from sieveline.plans.jobs import screen_portfolio


def portfolio_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 1000
) -> DataFrame:
    """New files below ``path``."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def screen_stream(
    portfolio: DataFrame,
    output: str,
    checkpoint: str,
    rules: S.ScreeningRules = S.ScreeningRules(),
    available_now: bool = True,
) -> StreamingQuery:
    """Write flat decisions as Parquet, exactly once per input row."""
    writer = (
        screen_portfolio(portfolio, rules)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(output)
