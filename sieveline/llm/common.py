"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.sources.staging import stage, staged_path, unstage

__all__ = ["bare_words", "fresh", "keep_first", "lower_ascii", "never_null", "stage", "staged_path", "table", "unit_hash", "unstage"]

# Separators of words besides the space: the ASCII controls tab to carriage return.
BLANKS = "\t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(c: str | Column) -> Column:
    return F.translate(c if isinstance(c, Column) else F.col(c), UPPER, UPPER.lower())


def bare_words(c: str | Column) -> Column:
    """The words of a text as an array; null counts as empty."""
    c = c if isinstance(c, Column) else F.col(c)
    plain = F.translate(F.coalesce(c, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(plain, " "), "")


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key, the same in every run and every engine with MD5."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def never_null(c: Column) -> Column:
    """A join key of an id that may be null."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def keep_first(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id, ids before none.

    ``members`` (id, words, root) is staged and names every row of ``docs`` by
    its id and the xxhash64 of its text. What goes is decided on those alone;
    whole rows are read once, and shuffled only for the join with the dropped
    keys. Rows that repeat both id and text are one.
    """
    order = F.struct(F.col("id").isNull().alias("none"), "id", "words")
    first = stage(members.groupBy("root").agg(F.min(order).alias("first")), "first")
    names = fresh(docs, "key"), fresh(docs, "words")
    keys = [never_null(F.col("id")).alias(names[0]), F.col("words").alias(names[1])]
    dropped = members.join(first, "root").where(~order.eqNullSafe(F.col("first"))).select(*keys).distinct()
    marked = docs.withColumns({names[0]: never_null(F.col(id_col)), names[1]: F.xxhash64(text_col)})
    kept = marked.join(stage(dropped, "dropped"), list(names), "left_anti")
    if not members.groupBy("id", "words").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(list(names))
    return kept.select(*docs.columns)
