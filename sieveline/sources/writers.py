"""Table and report sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
) -> None:
    """Write a table. Nested columns need Parquet or JSON."""
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def as_json_rows(df: DataFrame, column: str = "document") -> DataFrame:
    """Every row as one JSON document, nulls included."""
    packed = F.struct(*[F.col(c) for c in df.columns])
    return df.select(F.to_json(packed, {"ignoreNullFields": "false"}).alias(column))


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write report rows as JSON lines."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
