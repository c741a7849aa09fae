"""SimHash fingerprints and near-duplicate classes by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import keep_first, stage
from sieveline.llm.components import components

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
#: Segment values with more fingerprints than this are searched on both segments at once.
HOT_BUCKET = 64
HALF = 32
LOW = (1 << HALF) - 1


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of one text as a signed number; 0 for a text without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    made = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in made), dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">i8")[0])


def fingerprint_column(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """Fingerprints of a text column, a long. Words are runs without ASCII blanks, A-Z lower-cased."""

    @F.pandas_udf("long")
    def made(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return made(text)


def _segments(fps: DataFrame) -> DataFrame:
    """Two index rows per fingerprint: segment number, its value, the other segment."""
    fp = F.col("fp")
    high, low = F.shiftrightunsigned(fp, HALF), fp.bitwiseAND(F.lit(LOW))
    row = lambda n, a, b: F.struct(F.lit(n).alias("seg"), a.alias("val"), b.alias("rest"))
    return fps.select("fp", F.explode(F.array(row(0, high, low), row(1, low, high))).alias("r")).select("fp", "r.*")


def _ball(c: Column, centre: bool = True) -> Column:
    """The values of a 32-bit segment at distance 1, and the value itself if ``centre``."""
    masks = ([0] if centre else []) + [1 << i for i in range(HALF)]
    return F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: c.bitwiseXOR(m))


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE, hot: int = HOT_BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs at ``max_distance`` (0 to 2) or less.

    ``fps`` has one long column ``fp``. Two fingerprints at distance 2 agree to
    1 bit in one half, so each probes the ball of radius 1 around both halves
    (33 values each) in the tables of halves, and the full distance is verified
    in the join. That finds every link among halves with up to ``hot``
    fingerprints. A fuller half is split exactly instead: fingerprints equal in
    it are within 2 when they share a point of the balls around their other
    halves, and are tied to the smallest at that point; those 1 apart in it
    must be within 1 in the other, which is an equality on both halves. So no
    bucket is cut and none is paired with itself.
    """
    if not 0 <= max_distance <= 2:
        raise ValueError("two segments and balls of radius 1 cover distances 0 to 2")
    fps = fps.select(F.col("fp").cast("long").alias("fp")).where("fp is not null").distinct()
    if max_distance == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    rows = stage(_segments(fps), "segments")
    full = rows.groupBy("seg", "val").count().where(F.col("count") > hot).select("seg", "val", F.lit(True).alias("full"))
    marked = stage(rows.join(full, ["seg", "val"], "left"), "segments")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_distance

    table = marked.where("full is null").select("seg", "val", F.col("fp").alias("other"))
    probes = rows.select("seg", F.explode(_ball(F.col("val"))).alias("val"), "fp")
    found = probes.join(table, ["seg", "val"]).where((F.col("fp") < F.col("other")) & near).select("fp", "other")

    crowd = marked.where("full")
    points = crowd.select("seg", "val", F.explode(_ball(F.col("rest"), True)).alias("at"), "fp")
    if max_distance == 1:  # a shared point only proves distance 2; equality on the ball's centre proves 1
        points_to = crowd.select("seg", "val", F.col("rest").alias("at"), F.col("fp").alias("other"))
        tied = points.join(points_to, ["seg", "val", "at"]).where("fp < other").select("fp", "other")
    else:
        least = points.groupBy("seg", "val", "at").agg(F.min("fp").alias("other"))
        tied = points.join(least, ["seg", "val", "at"]).where("fp <> other").select("fp", "other")
    side = rows.select("seg", F.explode(_ball(F.col("val"), False)).alias("val"), F.col("rest").alias("at"), "fp")
    side = side.join(full.select("seg", "val"), ["seg", "val"], "left_semi")
    across = side.join(points.withColumnRenamed("fp", "other"), ["seg", "val", "at"]).where(near).select("fp", "other")
    return found.union(tied).union(across).distinct().select(F.col("fp").alias("a"), F.col("other").alias("b"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE
) -> DataFrame:
    """(id, fingerprint, component_id) per row of ``docs``, near copies sharing a component.

    The component is the smallest id among all rows reachable by links. Null
    and empty texts have fingerprint zero and are linked like any other.
    Repeated rows come out repeated. Rows whose id is null take part and get
    the smallest id of the others; with no id at all the component is null.
    Other columns are left out. An empty table gives an empty result.

    Identical texts meet as one fingerprint before any search, so a group of
    copies of any size is one row in the index.
    """
    rows = stage(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col)).alias("fp")), "prints")
    firsts = stage(rows.groupBy("fp").agg(F.min("id").alias("first")), "prints")
    tied = firsts.join(classes(firsts, max_distance), "fp")
    least = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    named = tied.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def classes(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(fp, root) for every different fingerprint of ``fps``; root is the smallest fingerprint reachable."""
    roots = components(links(fps.select("fp"), max_distance)).withColumnRenamed("node", "fp")
    return fps.select("fp").distinct().join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id.

    Columns are kept as they are, whatever their names. Rows that repeat the
    kept id within the component are one; a component without ids keeps any one
    of its rows. An empty table stays empty.
    """
    read = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("words"), fingerprint_column(F.col(text_col)).alias("fp"))
    rows = stage(read, "prints")
    members = rows.join(classes(rows, max_distance), "fp").select("id", "words", "root")
    return keep_first(docs, stage(members, "members"), id_col, text_col)
