"""Per-row feature contributions of a boosted-tree model.

Contributions are the Shapley values of the path-dependent expectation: a feature that is not known sends a
row down both branches in proportion to the curvature of the training rows that went there. They add up to
margin minus base.

A leaf is a box: it bounds each of the m features on its path, and a row is inside a bound (1) or not (0);
s is the share of training rows inside. The Shapley value of feature i at a leaf of value v is

    v (inside_i - s_i) times the integral over t from 0 to 1 of the product over j <> i of t inside_j + (1 - t) s_j

a polynomial of degree m - 1 in t, so Gauss-Legendre sums of (m + 1) / 2 points are exact. All leaves of a
tree and a block of rows are one array operation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.boosting import BoostedTrees, Tree
from sieveline.operators.models import KEY
from sieveline.sources.staging import spread

#: Numbers of a block of rows times a tree's leaves and path features.
BLOCK_CELLS = 1_000_000


@dataclass(frozen=True)
class Boxes:
    """The leaves of a tree: values, and per leaf and path feature its bounds and share, padded with feature -1."""

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def boxes(tree: Tree) -> Boxes:
    leaves: list[tuple[float, dict]] = []
    pending: list[tuple[int, dict]] = [(0, {})]
    while pending:
        at, box = pending.pop()
        f = int(tree.feature[at])
        if f < 0:
            leaves.append((float(tree.value[at]), box))
            continue
        low, high, share = box.get(f, (-np.inf, np.inf, 1.0))
        cut = float(tree.threshold[at])
        for child, bound in ((tree.left[at], (low, min(high, cut))), (tree.right[at], (max(low, cut), high))):
            part = tree.hessian[child] / tree.hessian[at]
            pending.append((int(child), {**box, f: (*bound, share * part)}))
    depth = max(len(b) for _, b in leaves)
    feature = np.full((len(leaves), depth), -1)
    low, high, share = np.full(feature.shape, -np.inf), np.full(feature.shape, np.inf), np.ones(feature.shape)
    for i, (_, box) in enumerate(leaves):
        for j, f in enumerate(sorted(box)):
            feature[i, j], (low[i, j], high[i, j], share[i, j]) = f, box[f]
    return Boxes(np.array([v for v, _ in leaves]), feature, low, high, share)


def tree_boxes(model: BoostedTrees) -> list[Boxes]:
    return [boxes(t) for t in model.trees]


def base_value(made: Sequence[Boxes]) -> float:
    """The expected margin when nothing is known about a row."""
    return float(sum((b.value * b.share.prod(axis=1)).sum() for b in made))


def _tree_contributions(x: np.ndarray, b: Boxes) -> np.ndarray:
    depth = b.feature.shape[1]
    if depth == 0:
        return np.zeros(x.shape)
    real = b.feature >= 0
    cells = x[:, np.maximum(b.feature, 0)]
    # Padding is inside a bound of share 1 and so has no effect.
    inside = np.where(real, (cells > b.low) & (cells <= b.high), True).astype(float)
    points, weights = np.polynomial.legendre.leggauss((depth + 1) // 2)
    others = np.zeros(inside.shape)
    for t, w in zip((points + 1) / 2, weights / 2):
        # Above 0 everywhere: t is inside (0, 1) and shares are above 0.
        factor = t * inside + (1 - t) * b.share
        others += w * factor.prod(axis=2, keepdims=True) / factor
    value = b.value[:, None] * (inside - b.share) * others
    place = np.zeros((b.feature.size, x.shape[1]))
    at = np.flatnonzero(real)
    place[at, b.feature.ravel()[at]] = 1.0
    return value.reshape(len(x), -1) @ place


def contributions_of(x: np.ndarray, made: Sequence[Boxes]) -> np.ndarray:
    """Contributions of every feature for a block of rows."""
    out = np.zeros(x.shape)
    for b in made:
        step = max(1, BLOCK_CELLS // max(b.feature.size, 1))
        for at in range(0, len(x), step):
            out[at : at + step] += _tree_contributions(x[at : at + step], b)
    return out


def row_contributions(
    model: BoostedTrees, df: DataFrame, features: Sequence[str], key: str = KEY
) -> DataFrame:
    """(key, reasons) with one struct of feature, value, contribution per feature.

    Rows stream through tasks in Arrow batches; what is broadcast grows with
    the model, not with the data.
    """
    names = list(features)
    if tuple(names) != model.features:
        raise ValueError("features must be the model's, in its order")
    leaves = df.sparkSession.sparkContext.broadcast(tree_boxes(model))
    vectors = spread(df).select(F.col(key), F.array(*[F.col(n).cast("double") for n in names]).alias("value"))

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("value").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                made = pa.array(contributions_of(x, leaves.value).ravel())
                made = pa.FixedSizeListArray.from_arrays(made, x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.record_batch([b.column(key), b.column("value"), made], [key, "value", "contribution"])

    kind = dict(vectors.dtypes)[key]
    wide = vectors.mapInArrow(explain, f"{key} {kind}, value array<double>, contribution array<double>")
    reasons = [
        F.struct(
            F.lit(n).alias("feature"),
            F.get("value", F.lit(i)).alias("value"),
            F.get("contribution", F.lit(i)).alias("contribution"),
        )
        for i, n in enumerate(names)
    ]
    return wide.select(key, F.array(*reasons).alias("reasons"))


def feature_contributions(rows: DataFrame, key: str = KEY) -> DataFrame:
    """One row per key and feature."""
    return rows.select(key, F.inline("reasons"))


def top_contributions(rows: DataFrame, key: str = KEY, top: int = 10) -> DataFrame:
    """The largest contributions of every row with rank and direction.

    Sorted inside the row's own array, so nothing is shuffled.
    """
    ordered = F.array_sort(
        F.transform(
            "reasons",
            lambda r: F.struct(
                (-F.abs(r["contribution"])).alias("order"), r["feature"].alias("feature"), r.alias("r")
            ),
        )
    )
    picked = rows.select(key, F.posexplode(F.slice(ordered, 1, top)).alias("position", "o"))
    direction = F.when(F.col("o.r.contribution") > 0, "compliant").otherwise("non_compliant")
    return picked.select(
        key, (F.col("position") + 1).alias("rank"), "o.r.*", direction.alias("direction")
    )


def global_contributions(long: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature and its share in percent."""
    means = long.groupBy("feature").agg(F.avg(F.abs(F.col("contribution"))).alias("mean_abs"))
    whole = Window.partitionBy()
    return means.withColumn(
        "importance_pct",
        F.coalesce(F.try_divide(F.col("mean_abs"), F.sum("mean_abs").over(whole)) * 100, F.lit(0.0)),
    )
