"""Exact nearest neighbours of binary codes by incremental multi-index hashing."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import stage

BITS = 64
#: Segments of a code. Their width should be near log2 of the number of codes.
SEGMENTS = 4
#: Codes that bound each query's distance before the search; a constant, whatever the table.
PROBE_CODES = 256


def sign_code(vector: Column) -> Column:
    """A vector of up to 64 numbers as a long: bit i is 1 where number i is above 0.

    Null and NaN numbers are 0 bits; a null vector has a null code, a longer
    one fails.
    """
    bit = lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    summed = F.aggregate(F.transform(vector, bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    too_long = F.raise_error(F.lit(f"a code has {BITS} bits; project longer vectors first"))
    return F.when(F.size(vector) > BITS, too_long.cast("long")).otherwise(summed)


def _masks(width: int, ones: int) -> Column:
    """All numbers of ``width`` bits with so many ones, as one constant array."""
    made = [sum(1 << i for i in c) for c in itertools.combinations(range(width), ones)]
    return F.from_json(F.lit(json.dumps(made)), "array<long>")


def _segment(code: Column, s: int, width: int) -> Column:
    return F.shiftrightunsigned(code, s * width).bitwiseAND(F.lit((1 << width) - 1))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def nearest(codes: DataFrame, queries: DataFrame, k: int = 10, segments: int = SEGMENTS) -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` nearest other rows of each query.

    ``codes`` and ``queries`` have columns ``id`` and ``code`` (long). Order is
    by Hamming distance, ties by id; a query's own id is not its neighbour. Rows
    without a code or id are neither found nor asked. Queries that repeat an id
    with one code are one query; of rows repeating an id and a code one is found.
    Fewer than ``k`` other rows give fewer results.

    Codes are indexed by each of their segments. In round r every open query
    looks up the values r bits from each of its own segments, and full
    distances are verified in the join. After it, everything within
    segments * (r + 1) - 1 bits has been found, so a query whose kth distance
    is no larger is closed. A bound on the kth distance, first from a constant
    number of codes and then from what has been found, keeps candidates that
    can't matter out of the join's result. Rows that share a code enter as one
    row with their k + 1 smallest ids, kept back to so many before the shuffle,
    and queries that share a code are searched once.
    """
    if BITS % segments or k < 1:
        raise ValueError("segments must divide 64, k must be 1 or more")
    width = BITS // segments
    rows = codes.where("id is not null and code is not null").select("id", "code").distinct()
    first = Window.partitionBy("code").orderBy("id")
    ranked = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    ids = stage(ranked.select("id", "code"), "codes")
    groups = stage(ids.groupBy("code").agg(F.count("*").alias("n")), "codes")
    asked = queries.where("id is not null and code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("q"))
    asked = stage(asked.distinct(), "queries")

    segment = lambda c, s: F.struct(F.lit(s).alias("seg"), _segment(c, s, width).alias("val"))
    table = groups.select("code", "n", F.explode(F.array(*(segment(F.col("code"), s) for s in range(segments)))).alias("e"))
    table = stage(table.select("e.seg", "e.val", "code", "n"), "segments")

    probe = [r.code for r in groups.orderBy(F.xxhash64("code")).limit(PROBE_CODES).collect()]
    open_ = asked.select("q").distinct()
    if len(probe) > k:
        known = F.from_json(F.lit(json.dumps(probe)), "array<long>")
        ordered = F.sort_array(F.transform(known, lambda c: F.bit_count(c.bitwiseXOR(F.col("q")))))
        open_ = open_.withColumn("bound", F.get(ordered, F.lit(k)))
    else:
        open_ = open_.withColumn("bound", F.lit(BITS))
    open_ = stage(open_, "open")
    found = None
    done = []
    for r in range(width + 1):
        if open_.isEmpty():
            break
        own = F.explode(F.array(*(segment(F.col("q"), s) for s in range(segments)))).alias("e")
        probes = open_.select("q", "bound", own).select(
            "q", "bound", "e.seg", F.explode(F.transform(_masks(width, r), lambda m: F.col("e.val").bitwiseXOR(m))).alias("val")
        )
        # Sizes are estimated without the explosion, so nothing may be broadcast here.
        near = probes.hint("merge").join(table, ["seg", "val"]).where(_distance("q", "code") <= F.col("bound"))
        new = near.select("q", "code", "n", _distance("q", "code").alias("distance"))
        if found is not None:
            new = new.unionByName(found.join(open_.select("q"), "q", "left_semi"))
        found = stage(new.distinct(), "found")
        # The distance within which k + 1 rows have been found: the query's own may be one of them.
        so_far = Window.partitionBy("q").orderBy("distance").rangeBetween(Window.unboundedPreceding, 0)
        reached = found.withColumn("rows", F.sum("n").over(so_far)).where(F.col("rows") > k)
        bound = reached.groupBy("q").agg(F.min("distance").alias("kth"))
        state = stage(open_.join(bound, "q", "left").select("q", F.least("bound", "kth").cast("int").alias("bound"), "kth"), "open")
        covered = segments * (r + 1) - 1
        closed = (F.col("kth") <= covered) if covered < BITS else F.lit(True)
        closed = F.coalesce(closed, F.lit(False))
        done.append(found.join(state.where(closed).select("q", "bound"), "q").where("distance <= bound").drop("bound"))
        open_ = state.where(~closed).select("q", "bound")
    if not done:
        done = [groups.select(F.col("code").alias("q"), "code", "n", F.lit(0).alias("distance")).limit(0)]
    hits = done[0]
    for d in done[1:]:
        hits = hits.unionByName(d)
    pairs = asked.join(hits, "q").join(ids, "code").where("id <> query_id")
    pairs = pairs.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    best = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "id", F.col("distance").cast("int").alias("distance"))
