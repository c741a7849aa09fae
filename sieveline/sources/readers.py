"""Readers with explicit schemas: no inference pass over the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline import schemas
from sieveline import settings as S


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    fmt: str = "parquet",
    columns: Sequence[str] | None = None,
    first: int | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Read a stored table, pruned to ``columns``, optionally the first rows.

    CSV needs a schema. ``first`` with ``order_by`` is a top-k, so the rows
    returned do not depend on file order.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        raise ValueError("reading CSV needs a schema")
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load(path)
    if columns is not None:
        df = df.select(*columns)
    if first is not None:
        df = df.orderBy(*order_by).limit(first) if order_by else df.limit(first)
    return df


def read_statements(
    spark: SparkSession, path: str, fmt: str = "csv", years: Sequence[str] = S.STATEMENT_YEARS
) -> DataFrame:
    """Long statements: symbol, account, type and one text column per year."""
    return read_table(spark, path, schemas.statement_schema(years), fmt)


def read_processed(
    spark: SparkSession, path: str, accounts: Sequence[str], fmt: str = "csv"
) -> DataFrame:
    """Wide companies: symbol and one amount per account."""
    return read_table(spark, path, schemas.processed_schema(accounts), fmt)


def read_features(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.FEATURES, fmt)


def read_labels(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.LABELS, fmt)


def read_sector_map(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """(symbol, sector) rows from JSON lines, Parquet or a CSV with a header."""
    return read_table(spark, path, schemas.SECTOR_MAP, fmt)


def read_sector_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, sector) rows from files that hold one JSON dictionary each, of any size.

    A file is cut into records where a string value ends and a comma follows,
    so many tasks read one dictionary. A value that itself ends a part of its
    text with an escaped quotation mark and a comma is not supported and fails.
    """
    kind = T.MapType(T.StringType(), T.StringType())
    cut = F.regexp_replace("value", r"^\s*\{", "")
    # All records but the last have lost the quotation mark that closes their value.
    inner = F.from_json(F.concat(F.lit("{"), cut, F.lit('"}')), kind)
    last = F.from_json(F.concat(F.lit("{"), F.regexp_replace(cut, r"\}\s*$", ""), F.lit("}")), kind)
    failed = F.raise_error(F.concat(F.lit("no part of a dictionary of strings: "), F.left("value", F.lit(80))))
    pairs = spark.read.option("lineSep", '",').text(path).where(F.trim("value") != "")
    return pairs.select(F.explode(F.coalesce(inner, last, failed.cast(kind))).alias("symbol", "sector")).select("symbol", "sector")


def model_columns(columns: Sequence[str]) -> list[str]:
    """The columns of a label table that are model inputs."""
    return [c for c in columns if c not in S.LABEL_COLUMNS]


def labeled_features(labels: DataFrame, features: DataFrame) -> tuple[DataFrame, list[str]]:
    """Labels with their features, and the names of the feature columns.

    Features are joined on symbol only when the label table has none. Columns
    both tables carry are taken from the labels.
    """
    if not model_columns(labels.columns):
        shared = [c for c in features.columns if c in labels.columns and c != "symbol"]
        labels = labels.join(features.drop(*shared), "symbol", "left")
    return labels, model_columns(labels.columns)
