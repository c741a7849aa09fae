"""One document of each class of near copies: classes by fingerprint, then by the shingles of what stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import setsketch, simhash
from sieveline.llm.common import keep_first, never_null, stage

SHINGLE_WORDS = 5


def classes_of(docs: DataFrame, id_col: str, text_col: str, percent: int, words: int) -> DataFrame:
    """(id, words, root) of every row of ``docs``, staged; ``words`` is the hash of its text.

    Texts are read twice: once for fingerprints and registers, once for those
    that share a band with another. The rest of the work is on numbers.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("words"), F.col(text_col).alias("text"))
    read = rows.select("id", "words", simhash.fingerprint_column(F.col("text")).alias("fp"), setsketch.sketch_column(F.col("text"), words).alias("s"))
    prints = stage(read.select("id", "words", "fp", "s.*"), "prints")
    by_print = stage(simhash.classes(prints), "print-classes")

    order = F.struct(F.col("id").isNull().alias("none"), "id", "words").alias("first")
    classed = prints.select("id", "words", "fp", "n", "node").join(by_print, "fp")
    # The row that stands for a class of fingerprints stands for it among the sets, too.
    firsts = stage(classed.groupBy("root").agg(F.min(F.struct(order, "n", "node")).alias("r")).select("root", "r.*"), "firsts")
    sets = firsts.where("n > 0").groupBy("node").agg(F.min("first").alias("first"))
    # Rows of one set have equal registers, so any of them will do.
    made = prints.join(sets.select("node"), "node", "left_semi").groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("made").alias("made"))
    nodes = stage(sets.join(made, "node").withColumn("num", F.monotonically_increasing_id()), "nodes")

    def texts(wanted: DataFrame) -> DataFrame:
        known = nodes.join(wanted, "num").select("num", never_null(F.col("first.id")).alias("key"), F.col("first.words").alias("words"))
        keyed = rows.select(never_null(F.col("id")).alias("key"), "words", "text")
        return keyed.join(known, ["key", "words"]).groupBy("num").agg(F.any_value("text").alias("text"))

    tied = setsketch.links(nodes.select("num", "n", "made"), texts, percent, words)
    named = nodes.select("node", "num").join(tied.withColumnRenamed("root", "set_root"), "num", "left")
    named = firsts.select("root", "node").join(named.select("node", F.coalesce("set_root", "num").alias("set_root")), "node", "left")
    # A class without words has no set: its fingerprints' root, on another scale, stands for it.
    last = F.coalesce(F.concat(F.lit("s"), F.col("set_root")), F.concat(F.lit("f"), F.col("root")))
    named = stage(named.select("root", last.alias("last")), "print-classes")
    return stage(classed.select("id", "words", "root").join(named, "root").select("id", "words", F.col("last").alias("root")), "members")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = setsketch.PERCENT, words: int = SHINGLE_WORDS
) -> DataFrame:
    """``docs`` with one row of each class of near copies, the one with the smallest id.

    Near copies are texts whose SimHash fingerprints are linked, and texts of
    different fingerprint whose sets of ``words``-word shingles have ``percent``
    in a hundred in common; classes are closed under both. Columns are kept as
    they are, whatever their names. Texts without words are one class. A class
    without ids keeps any one of its rows, an empty table stays empty.
    """
    return keep_first(docs, classes_of(docs, id_col, text_col, percent, words), id_col, text_col)
