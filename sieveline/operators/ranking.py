"""Ranks, running counts, exact quantiles and histograms over whole tables.

A window without partition columns sends every row to one task. Here the rows
are first reduced to distinct values with counts, sorted by range over all
tasks, and staged together with the number of the partition each row landed
in. Running totals are then a small prefix sum over partitions plus a window
inside each partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.sources.staging import stage

PART = "_part"


def running_counts(
    df: DataFrame,
    value: str,
    sums: Mapping[str, Column] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per distinct ``value`` (within ``by``), ascending, with running totals.

    ``sums`` maps a name to the column to add up; it defaults to a row count
    ``n``. Each name gives ``<name>`` (at this value), ``<name>_before``
    (below it) and ``<name>_total``. Null values are left out.

    A value shared by many rows is one row after the partial aggregation, so a
    hot value costs nothing more than a rare one.
    """
    sums = sums or {"n": F.lit(1)}
    by = list(by)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    )
    placed = stage(
        counts.sort(*by, value).withColumn(PART, F.spark_partition_id()), "running-counts"
    )
    # One row per partition and group: bounded by the number of partitions
    # plus the number of groups.
    totals = placed.groupBy(*by, PART).agg(*[F.sum(n).alias(f"_{n}") for n in sums])
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    prefix = totals.select(
        *by,
        PART,
        *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}_prefix") for n in sums],
        *[F.sum(f"_{n}").over(whole).alias(f"{n}_total") for n in sums],
    )
    inside = (
        Window.partitionBy(*by, PART).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = placed.join(F.broadcast(prefix), [*by, PART])
    return joined.select(
        *by,
        value,
        PART,
        *sums,
        *[
            (F.col(f"_{n}_prefix") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_before")
            for n in sums
        ],
        *[f"{n}_total" for n in sums],
    )


def percent_rank_table(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Every distinct value with its average-tie rank and that rank over n."""
    ranked = running_counts(df, value, by=by)
    average = F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)
    return ranked.select(
        *by, value, "n", average.alias("avg_rank"), (average / F.col("n_total")).alias("pct_rank")
    )


def with_percent_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add the average-tie percent rank of ``value`` to every row.

    Values held by at least one in a thousand rows (so at most a thousand
    values) are looked up in a broadcast table; all other rows join by shuffle
    and have no hot key left. Null values rank null.
    """
    table = stage(percent_rank_table(df, value), "percent-ranks")
    total = table.agg(F.sum("n")).scalar()
    hot = table.where(F.col("n") * 1000 >= total)
    rare = table.where(F.col("n") * 1000 < total)
    key = "_rank_key"
    near = F.broadcast(hot.select(F.col(value).alias(key), F.col("pct_rank").alias("_hot")))
    marked = df.join(near, df[value].eqNullSafe(near[key]), "left").drop(key)
    settled = marked.where(F.col("_hot").isNotNull() | F.col(value).isNull())
    open_rows = marked.where(F.col("_hot").isNull() & F.col(value).isNotNull()).drop("_hot")
    far = rare.select(F.col(value).alias(key), F.col("pct_rank").alias(name))
    found = open_rows.join(far, open_rows[value] == far[key], "left").drop(key)
    return settled.withColumnRenamed("_hot", name).unionByName(found)


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value) rows of the numeric ``columns``, nulls left out."""
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot([], list(columns), "feature", "value").where(F.col("value").isNotNull())


def _pick(ranked: DataFrame, by: Sequence[str], before: Column, total: Column) -> DataFrame:
    """Interpolate at ``share`` of ``total`` rows; ``before`` counts the rows below a value."""
    spot = F.col("share") * (total - 1)
    low, high = F.floor(spot), F.ceil(spot)
    after = before + F.col("n")

    def holds(at: Column) -> Column:
        return (before <= at) & (at < after)

    ends = (
        ranked.where(holds(low) | holds(high))
        .groupBy(*by)
        .agg(
            F.max(F.when(holds(low), F.col("value"))).alias("lo"),
            F.max(F.when(holds(high), F.col("value"))).alias("hi"),
            F.max(spot - low).alias("part"),
        )
    )
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")
    return ends.select(*by, value.alias("quantile"))


def _all_quantiles(long: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Rank every distinct value."""
    ranked = running_counts(long, "value", by=["feature"])
    grid = F.explode(F.array(*[F.lit(s) for s in shares])).alias("share")
    return _pick(
        ranked.select("*", grid), ["feature", "share"], F.col("n_before"), F.col("n_total")
    )


def _bracketed_quantiles(long: DataFrame, shares: Sequence[float], accuracy: int) -> DataFrame:
    """Rank only the values between two sketched neighbours of each quantile.

    The sketch gives bounds a few ranks in ``accuracy`` apart. Rows below a
    bound are counted, rows between the bounds are ranked.
    """
    slack = 4.0 / accuracy
    ends = [e for s in shares for e in (max(s - slack, 0.0), min(s + slack, 1.0))]
    sketch = long.groupBy("feature").agg(F.percentile_approx("value", ends, accuracy).alias("_ends"))
    brackets = [
        F.struct(
            F.lit(s).alias("share"),
            (F.lit(float("-inf")) if s <= slack else F.get("_ends", F.lit(2 * i))).alias("lo"),
            (F.lit(float("inf")) if s >= 1.0 - slack else F.get("_ends", F.lit(2 * i + 1))).alias("hi"),
        )
        for i, s in enumerate(shares)
    ]
    # One row per column.
    bounds = stage(sketch.select("feature", F.array(*brackets).alias("brackets")), "quantile-bounds")
    placed = long.join(F.broadcast(bounds), "feature")
    below = placed.groupBy("feature").agg(
        F.count("*").alias("_total"),
        *[
            F.count_if(F.col("value") < F.get("brackets", F.lit(i))["lo"]).alias(f"_below_{i}")
            for i in range(len(shares))
        ],
    )
    counts = below.select(
        "feature",
        "_total",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(s).alias("share"), F.col(f"_below_{i}").alias("_below"))
                    for i, s in enumerate(shares)
                ]
            )
        ),
    )
    near = F.filter("brackets", lambda b: (F.col("value") >= b["lo"]) & (F.col("value") <= b["hi"]))
    inside = placed.select("feature", "value", F.explode(near).alias("_b")).select(
        "feature", "value", F.col("_b.share").alias("share")
    )
    ranked = running_counts(inside, "value", by=["feature", "share"])
    # One row per column and share.
    joined = ranked.join(F.broadcast(counts), ["feature", "share"])
    return _pick(joined, ["feature", "share"], F.col("_below") + F.col("n_before"), F.col("_total"))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    shares: Sequence[float],
    accuracy: int = 10000,
) -> DataFrame:
    """(feature, share, quantile) with linear interpolation between neighbours.

    Exact, and never holds a column in one task. It passes over ``df`` several
    times and runs jobs while it is called, so give it a stored or staged table.
    A sketch bounds every quantile and only the values between the bounds are
    ranked; should a bound miss, the whole table is.
    """
    shares = [float(s) for s in shares]
    long = long_values(df, columns)
    found = stage(_bracketed_quantiles(long, shares, accuracy), "quantiles")
    filled = long.groupBy("feature").agg(F.count("*").alias("n")).count()
    if found.where(F.col("quantile").isNotNull()).count() == filled * len(shares):
        return found
    return _all_quantiles(long, shares)


def equal_width_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in ``bins`` equal bins between min and max, the last one closed."""
    v = F.col(value)
    ends = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"))).scalar()
    placed = df.where(v.isNotNull()).select(v.alias("_v")).withColumn("_ends", ends)
    width = (F.col("_ends.hi") - F.col("_ends.lo")) / F.lit(float(bins))
    raw = F.floor(F.coalesce(F.try_divide(F.col("_v") - F.col("_ends.lo"), width), F.lit(0.0)))
    return (
        placed.select(F.least(raw, F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
