"""Splits and folds by a hash of the key.

A row's part depends on keys and the seed alone, so a retried task or a second run puts it in the same part.
The plain forms cut at hash values and keep class shares up to sampling noise. The stratified ones rank each
class by the hash, ties by key, and cut or deal the ranks, so class shares are exact. Ranks come from
``running_counts``: no task holds a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.expressions import unit_hash
from sieveline.operators.ranking import running_counts


def with_split(
    df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, name: str = "is_test"
) -> DataFrame:
    """Add a flag for the test part."""
    return df.withColumn(name, unit_hash(key, seed) < test_size)


def with_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Add a fold number 0..k-1."""
    return df.withColumn(name, F.floor(unit_hash(key, seed) * k).cast("int"))


def _with_ranked(df: DataFrame, key: str, label: str, seed: int, name: str, part: Column, otherwise: Column) -> DataFrame:
    """Add ``part``, made of the row's ``_rank`` in its class (0 first) and the class's ``_size``."""
    order = F.struct(unit_hash(key, seed).alias("u"), F.col(key).alias("k"))
    ranked = running_counts(df.select(label, order.alias("_order")), "_order", by=[label])
    parts = ranked.select(
        F.col(label).alias("_label"), F.col("_order.k").alias("_key"), F.col("n_before").alias("_rank"), F.col("n_total").alias("_size")
    ).select("_label", "_key", part.alias("_part"))
    joined = df.join(parts, (df[key] == parts["_key"]) & (df[label] == parts["_label"]), "left")
    return joined.withColumn(name, F.coalesce("_part", otherwise)).drop("_label", "_key", "_part")


def with_exact_split(
    df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = 42, name: str = "is_test"
) -> DataFrame:
    """Add a flag for the test part: the rounded share of every class.

    Keys are expected to be unique; rows that share one stay together. Rows
    without key or label are never test rows.
    """
    quota = F.round(F.col("_size") * F.lit(test_size))
    return _with_ranked(df, key, label, seed, name, F.col("_rank") < quota, F.lit(False))


def with_stratified_folds(
    df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42, name: str = "fold"
) -> DataFrame:
    """Add a fold number 0..k-1. Fold sizes of a class differ by one row at most.

    Rows without key or label have no fold.
    """
    return _with_ranked(df, key, label, seed, name, F.pmod("_rank", F.lit(k)).cast("int"), F.lit(None).cast("int"))
