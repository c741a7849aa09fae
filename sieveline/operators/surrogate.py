"""A local linear model around each row, fitted to the model's own scores.

Features are cut at their quartiles. A copy of a row draws a bin for every feature by the bins' shares in the
reference rows, and a value from the normal law of the bin, cut at its ends. Copies are described by where
they share the row's bin; they weigh less the fewer bins they share, and a weighted ridge fit of the scores on
those flags gives the weights. Copies are made, scored and summed in the task that holds the row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.operators.boosting import BoostedTrees
from sieveline.operators.models import KEY
from sieveline.operators.ranking import exact_quantiles
from sieveline.sources.staging import spread

QUARTILES = (0.25, 0.5, 0.75)
#: Width of the weights over the root of the number of features (fixed value).
KERNEL = 0.75
#: Points at which the law of a bin is tabled.
STEPS = 257
#: Rows whose copies are scored at once.
ROWS_AT_ONCE = 64


def bin_column(value: Column, cuts: Sequence[float]) -> Column:
    """The number of cuts below a value."""
    total = F.lit(0)
    for c in cuts:
        total = total + (value > F.lit(float(c))).cast("int")
    return total


@dataclass(frozen=True)
class Bins:
    """Per feature the distinct cuts, and per bin its share and a table of values at even steps of its law."""

    features: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]
    shares: tuple[np.ndarray, ...]
    values: tuple[np.ndarray, ...]


def _law(mean: float, deviation: float, low: float, high: float) -> np.ndarray:
    """Values of the normal law cut to [low, high] at even steps of its distribution."""
    if not deviation > 0 or not high > low:
        return np.full(STEPS, mean)
    law = NormalDist(mean, deviation)
    a, b = law.cdf(low), law.cdf(high)
    inner = [law.inv_cdf(min(max(p, 1e-12), 1 - 1e-12)) for p in np.linspace(a, b, STEPS)[1:-1]]
    return np.clip(np.array([low, *inner, high]), low, high)


def quartile_cuts(reference: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, ...]]:
    """The different quartiles of each feature, exact; a feature without values has none."""
    got: dict[str, set[float]] = {f: set() for f in features}
    for r in exact_quantiles(reference, features, QUARTILES).collect():
        got[r.feature].add(float(r.quantile))
    return {f: tuple(sorted(v)) for f, v in got.items()}


def bin_statistics(reference: DataFrame, features: Sequence[str], cuts: dict[str, tuple[float, ...]]) -> DataFrame:
    """(feature, bin, n, mean, deviation, low, high) over the reference rows; at most four bins a feature."""
    each = F.array(*[F.struct(F.lit(f).alias("feature"), bin_column(F.col(f), cuts[f]).alias("bin"), F.col(f).cast("double").alias("value")) for f in features])
    v = F.col("value")
    return reference.select(F.inline(each)).where(v.isNotNull()).groupBy("feature", "bin").agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"), F.min(v).alias("low"), F.max(v).alias("high")
    )


def fit_bins(reference: DataFrame, features: Sequence[str]) -> Bins:
    cuts = quartile_cuts(reference, features)
    got = {(r.feature, r.bin): r for r in bin_statistics(reference, features, cuts).collect()}
    shares, values = [], []
    for f in features:
        rows = [got.get((f, b)) for b in range(len(cuts[f]) + 1)]
        n = np.array([r.n if r else 0 for r in rows], dtype=float)
        shares.append(n / max(n.sum(), 1.0))
        values.append(np.stack([_law(r.mean, r.deviation, r.low, r.high) if r else np.zeros(STEPS) for r in rows]))
    return Bins(tuple(features), tuple(cuts[f] for f in features), tuple(shares), tuple(values))


def copies(x: np.ndarray, salt: int, bins: Bins, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """(flags, values) of the copies of one row; copy 0 is the row itself. The draws depend on ``salt`` alone."""
    flags, values = copies_of(x[None], [salt], bins, samples)
    return flags[0], values[0]


def copies_of(x: np.ndarray, salts: Sequence[int], bins: Bins, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """The copies of several rows, (rows, copies, features)."""
    rows, d = x.shape
    draws = np.stack([np.random.Generator(np.random.Philox(key=int(s) % 2**64)).random((2, samples, d)) for s in salts], axis=1)
    flags, values = np.empty((rows, samples, d)), np.empty((rows, samples, d))
    for j, cuts in enumerate(bins.cuts):
        own = np.searchsorted(cuts, x[:, j], side="left")
        drawn = np.zeros((rows, samples), dtype=np.int64)
        # A share's end after the last cut is never passed.
        for end in np.cumsum(bins.shares[j])[: len(cuts)]:
            drawn += draws[0, :, :, j] >= end
        at = draws[1, :, :, j] * (STEPS - 1)
        low = at.astype(int)
        table, place = bins.values[j].ravel(), drawn * STEPS + low
        start = table.take(place)
        values[:, :, j] = start + (table.take(place + (low < STEPS - 1)) - start) * (at - low)
        flags[:, :, j] = drawn == own[:, None]
    flags[:, 0], values[:, 0] = 1.0, x
    return flags, values


def copy_weights(flags: np.ndarray) -> np.ndarray:
    """By the distance of a copy's flags from all ones."""
    d = flags.shape[-1]
    return np.sqrt(np.exp(-(d - flags.sum(axis=-1)) / (KERNEL * KERNEL * d)))


def ridge(flags: np.ndarray, weights: np.ndarray, scores: np.ndarray, penalty: float) -> np.ndarray:
    """Weights and intercept (last, not penalised) of stacked fits: flags (rows, copies, features)."""
    a = np.concatenate([flags, np.ones((*flags.shape[:2], 1))], axis=2)
    wa = a * weights[..., None]
    matrix = wa.transpose(0, 2, 1) @ a
    matrix[:, np.arange(a.shape[2] - 1), np.arange(a.shape[2] - 1)] += penalty
    return np.linalg.solve(matrix, (wa * scores[..., None]).sum(axis=1)[..., None])[..., 0]


def _top(flags: np.ndarray, weights: np.ndarray, scores: np.ndarray, penalty: float, top: int) -> np.ndarray:
    """Stacked fits on each row's ``top`` features of largest weight; NaN for the others."""
    full = ridge(flags, weights, scores, penalty)
    d = flags.shape[2]
    chosen = np.sort(np.argsort(-np.abs(full[:, :d]), axis=1, kind="stable")[:, :top], axis=1)
    again = ridge(np.take_along_axis(flags, chosen[:, None, :], axis=2), weights, scores, penalty)
    out = np.full(full.shape, np.nan)
    np.put_along_axis(out, chosen, again[:, :-1], axis=1)
    out[:, d] = again[:, -1]
    return out


def local_surrogate(
    model: BoostedTrees,
    df: DataFrame,
    features: Sequence[str],
    samples: int = 200,
    top: int = 3,
    penalty: float = 1.0,
    key: str = KEY,
    seed: int = 42,
    reference: DataFrame | None = None,
) -> DataFrame:
    """(key, feature, weight, intercept): the ``top`` local weights of every row of ``df``.

    Bins come from ``reference``, by default ``df`` itself, which is then read
    several times and should be stored or staged. Draws depend on key and seed
    only, so a retried task repeats them. Nothing is shuffled; what is broadcast
    is the model and four bins a feature.
    """
    names = list(features)
    shared = df.sparkSession.sparkContext.broadcast((fit_bins(reference if reference is not None else df, names), model))
    salt = F.xxhash64(F.col(key).cast("string"), F.lit(seed))
    rows = spread(df).select(key, salt.alias("salt"), F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]).alias("x"))
    kind = rows.schema[key].dataType

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, scorer = shared.value
        for b in batches:
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(at, ROWS_AT_ONCE)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                flags, values = copies_of(x, part.column("salt").to_pylist(), bins, samples)
                scores = (1 / (1 + np.exp(-scorer.margins(values.reshape(-1, x.shape[1]))))).reshape(flags.shape[:2])
                out = _top(flags, copy_weights(flags), scores, penalty, min(top, x.shape[1]))
                yield pa.record_batch([part.column(key), pa.array(out.tolist(), pa.list_(pa.float64()))], [key, "weights"])

    out = T.StructType([T.StructField(key, kind), T.StructField("weights", T.ArrayType(T.DoubleType()))])
    solved = rows.mapInArrow(solve, out)
    each = F.array(
        *[
            F.struct(F.lit(n).alias("feature"), F.get("weights", F.lit(i)).alias("weight"))
            for i, n in enumerate(names)
        ]
    )
    intercept = F.get("weights", F.lit(len(names))).alias("intercept")
    return solved.select(key, intercept, F.inline(F.filter(each, lambda r: ~F.isnan(r["weight"]))))
