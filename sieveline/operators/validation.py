"""Nested cross-validation, probability calibration and learning curves."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline import settings as S
from sieveline.functions.expressions import unit_hash
from sieveline.operators import metrics as M
from sieveline.operators.boosting import BoostedTrees, Fit, probability_column
from sieveline.operators.models import KEY, LABEL, fit_all, with_prediction
from sieveline.operators.splits import with_stratified_folds
from sieveline.operators.tuning import combinations, weighted_f1
from sieveline.sources.staging import stage


def nested_predictions(
    df: DataFrame,
    features: Sequence[str],
    params: S.BoostParams,
    grid: Mapping[str, Sequence] | None = None,
    inner: int = 3,
    outer: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Out-of-fold P(1) for every row, staged, by the settings that won the search inside its outer training rows.

    All settings of all inner folds of all outer folds are fitted together, then
    the winners, one for each outer fold.
    """
    folded = with_stratified_folds(df, KEY, LABEL, outer, seed, "outer_fold")
    folded = stage(with_stratified_folds(folded, KEY, LABEL, inner, seed + 1, "inner_fold"), "nested-folds")
    tried = [replace(params, **c) for c in combinations(grid)] if grid else [params]
    chosen = [tried[0]] * outer
    if len(tried) > 1:
        cells = [(o, j, i) for o in range(outer) for j in range(len(tried)) for i in range(inner)]
        models = fit_all(folded, features, [Fit(tried[j], f"outer_fold <> {o} and inner_fold <> {i}") for o, j, i in cells])
        scored = folded.select(LABEL, "outer_fold", "inner_fold", probability_column(models).alias("s"))
        at = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(c, "oji")], F.get("s", F.lit(m)).alias("p")) for m, c in enumerate(cells)])
        each = scored.select(LABEL, "outer_fold", "inner_fold", F.inline(at)).where("o <> outer_fold and i = inner_fold")
        counts = each.groupBy("o", "j", "i", LABEL, (F.col("p") >= 0.5).cast("int").alias("prediction")).agg(F.count("*").alias("n"))
        means = weighted_f1(stage(counts, "nested-counts"), ["o", "j", "i"]).groupBy("o", "j").agg(F.avg("weighted_f1").alias("m"))
        got = {(r.o, r.j): r.m for r in means.collect()}
        chosen = [tried[max(range(len(tried)), key=lambda j: (got.get((o, j), 0.0), -j))] for o in range(outer)]
    models = fit_all(folded, features, [Fit(p, f"outer_fold <> {o}") for o, p in enumerate(chosen)])
    own = F.get(probability_column(models), F.col("outer_fold"))
    return stage(folded.withColumn("probability", own), "outer-predictions")


def nested_cross_validation(
    df: DataFrame,
    features: Sequence[str],
    params: S.BoostParams,
    grid: Mapping[str, Sequence] | None = None,
    inner: int = 3,
    outer: int = 5,
    seed: int = 42,
) -> DataFrame:
    """One row of pooled out-of-fold metrics with the mean and spread of fold F1.

    With a ``grid`` every outer fold searches its own training rows; without
    one the given settings are fitted as they are.
    """
    return nested_metrics(nested_predictions(df, features, params, grid, inner, outer, seed))


def nested_metrics(pooled: DataFrame) -> DataFrame:
    predicted = with_prediction(pooled)
    per_fold = M.hard_metrics(M.confusion(predicted, by=["outer_fold"]), ("f1",))
    spread = per_fold.agg(F.avg("f1").alias("cv_mean"), F.stddev_pop("f1").alias("cv_std"))
    whole = M.hard_metrics(M.confusion(predicted), ("accuracy", "precision", "recall", "f1"))
    losses = M.probability_losses(pooled)
    return whole.withColumns(
        {
            "cv_mean": spread.select("cv_mean").scalar(),
            "cv_std": spread.select("cv_std").scalar(),
            "auc": M.auc(pooled).scalar(),
            "log_loss": losses.select("log_loss").scalar(),
            "brier_score": losses.select("brier_score").scalar(),
        }
    )


@dataclass(frozen=True)
class Isotonic:
    """A monotone step function as a table: blocks with their range of scores and their value, in order.

    Between blocks the value runs straight from one to the next, outside it is
    the first or the last.
    """

    blocks: DataFrame

    def apply(self, df: DataFrame, score: str, name: str) -> DataFrame:
        """Add the calibrated value. Different scores are looked up once each, however often they occur."""
        ends = self.blocks.select(F.inline(F.array(F.struct(F.col("low").alias("at"), "value"), F.struct(F.col("high").alias("at"), "value"))))
        points = ends.groupBy("at").agg(F.max("value").alias("value")).select("at", "value", F.lit(0).alias("asked"))
        asked = df.select(F.col(score).cast("double").alias("at")).distinct().select("at", F.lit(None).cast("double").alias("value"), F.lit(1).alias("asked"))
        both = points.unionByName(asked.where("at is not null"))
        looked = filled_between(both)
        return df.join(looked.withColumnsRenamed({"at": "_at", "value": name}), F.col(score).cast("double").eqNullSafe(F.col("_at")), "left").drop("_at")


def filled_between(rows: DataFrame) -> DataFrame:
    """(at, value) of the asked rows, between the known neighbours of each; rows are sorted by range over all tasks.

    The last point of earlier tasks and the first of later ones come from one row per task.
    """
    placed = stage(rows.sort("at", "asked").withColumn("part", F.spark_partition_id()), "between")
    known = placed.where("asked = 0")
    ends = known.groupBy("part").agg(F.min(F.struct("at", "value")).alias("first"), F.max(F.struct("at", "value")).alias("last")).collect()
    firsts = sorted((r.part, r["first"].at, r["first"].value, r["last"].at, r["last"].value) for r in ends)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches))
        if not held.num_rows:
            return
        held = held.sort_by([("at", "ascending"), ("asked", "ascending")])
        at, value, asked = (held.column(c).to_numpy() for c in ("at", "value", "asked"))
        part = held.column("part")[0].as_py()
        before = [(a, v) for p, _, _, a, v in firsts if p < part][-1:]
        after = [(a, v) for p, a, v, _, _ in firsts if p > part][:1]
        xs = [x for x, _ in before] + at[asked == 0].tolist() + [x for x, _ in after]
        ys = [y for _, y in before] + value[asked == 0].tolist() + [y for _, y in after]
        want = at[asked == 1]
        yield pa.record_batch([pa.array(want), pa.array(np.interp(want, xs, ys) if xs else np.full(len(want), np.nan))], ["at", "value"])

    return placed.repartition("part").mapInArrow(_by_part(fill), "at double, value double")


def _by_part(fill):
    """Run ``fill`` for each value of ``part`` in a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if whole is None or not whole.num_rows:
            return
        parts = whole.column("part").to_numpy()
        for p in np.unique(parts):
            yield from fill(iter(whole.filter(pa.array(parts == p)).to_batches()))

    return run


def pooled(low: np.ndarray, high: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
    """Adjacent blocks joined until their means rise strictly (pool adjacent violators)."""
    out: list[list[float]] = []
    for block in zip(low, high, n, total):
        out.append(list(block))
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            last = out.pop()
            out[-1] = [out[-1][0], last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    return tuple(np.array(c) for c in zip(*out)) if out else (low, high, n, total)


def _pool_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pool a task's blocks, which come in order; only pooled blocks are held."""
    held: tuple[np.ndarray, ...] | None = None
    names = ["low", "high", "n", "total"]
    for b in batches:
        new = tuple(b.column(c).to_numpy() for c in names)
        held = pooled(*(new if held is None else [np.r_[x, y] for x, y in zip(held, new)]))
    if held is not None and len(held[0]):
        yield pa.record_batch([pa.array(c) for c in held], names)


def isotonic(scored: DataFrame, score: str, label: str = LABEL) -> Isotonic:
    """The monotone function of ``score`` nearest to the labels in squares.

    Equal scores are one block from the start. Blocks are sorted by range over
    all tasks and pooled inside each; neighbouring tasks are then joined, half
    as many each round, and pooled again, so a round holds what the round
    before could not pool. Sums are whole numbers, so the result is the same
    whatever the ranges. The points never reach the driver.
    """
    s = F.col(score).cast("double")
    points = scored.where(s.isNotNull()).groupBy(s.alias("low")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("total"))
    points = points.select("low", F.col("low").alias("high"), "n", "total").sort("low")
    schema = "low double, high double, n double, total double"
    blocks = stage(points.mapInArrow(_pool_task, schema), "blocks")
    parts = points.rdd.getNumPartitions()
    while parts > 1:
        parts = (parts + 1) // 2
        ranged = blocks.repartitionByRange(parts, "low").sortWithinPartitions("low") if parts > 1 else blocks.coalesce(1).sortWithinPartitions("low")
        blocks = stage(ranged.mapInArrow(_pool_task, schema), "blocks")
    return Isotonic(blocks.withColumn("value", F.col("total") / F.col("n")))


def smoothed_targets(scored: DataFrame, score: str, label: str = LABEL) -> DataFrame:
    """Each row twice, as label 1 and 0, weighted by Platt's target: (n1 + 1) / (n1 + 2) for 1 and 1 / (n0 + 2) for 0."""
    counts = scored.agg(F.struct(F.count_if(F.col(label) == 1).alias("ones"), F.count_if(F.col(label) == 0).alias("zeros"))).scalar()
    counted = scored.withColumn("_counts", counts)
    ones, zeros = F.col("_counts.ones"), F.col("_counts.zeros")
    target = F.when(F.col(label) == 1, (ones + 1) / (ones + 2)).otherwise(F.lit(1.0) / (zeros + 2))
    both = F.array(*[F.struct(F.lit(y).alias("y"), w.alias("w")) for y, w in ((1, target), (0, F.lit(1.0) - target))])
    return counted.select(F.col(score).cast("double").alias("_raw"), F.inline(both)).groupBy("_raw", "y").agg(F.sum("w").alias("w"))


@dataclass(frozen=True)
class Sigmoid:
    """1 / (1 + exp(-(slope * score + intercept)))."""

    slope: float
    intercept: float

    def apply(self, df: DataFrame, score: str, name: str) -> DataFrame:
        z = F.lit(self.slope) * F.col(score) + F.lit(self.intercept)
        return df.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def sigmoid(scored: DataFrame, score: str, label: str = LABEL) -> Sigmoid:
    """The logistic curve of the score fitted to Platt's smoothed targets."""
    rows = VectorAssembler(inputCols=["_raw"], outputCol="_score").transform(smoothed_targets(scored, score, label))
    made = LogisticRegression(featuresCol="_score", labelCol="y", weightCol="w", maxIter=1000, tol=1e-12).fit(rows)
    return Sigmoid(float(made.coefficients[0]), float(made.intercept))


CALIBRATORS = {"sigmoid": sigmoid, "isotonic": isotonic}


@dataclass(frozen=True)
class Calibrated:
    """Fold models with their calibrators; the probability is their mean."""

    models: Sequence[BoostedTrees]
    calibrators: Sequence[Sigmoid | Isotonic]
    held_out: DataFrame

    def predict(self, df: DataFrame) -> DataFrame:
        k = len(self.models)
        out = stage(df.withColumn("_raw", probability_column(self.models)), "calibrated-input")
        out = out.withColumns({f"_raw_{i}": F.get("_raw", F.lit(i)) for i in range(k)}).drop("_raw")
        for i, c in enumerate(self.calibrators):
            out = c.apply(out, f"_raw_{i}", f"_calibrated_{i}")
        total = reduce(lambda a, b: a + b, [F.col(f"_calibrated_{i}") for i in range(k)])
        names = [f"_{kind}_{i}" for kind in ("raw", "calibrated") for i in range(k)]
        return with_prediction(out.withColumn("probability", total / F.lit(float(k))).drop(*names))


def calibrate(
    df: DataFrame,
    features: Sequence[str],
    params: S.BoostParams,
    method: str = "sigmoid",
    k: int = 5,
    seed: int = 42,
) -> Calibrated:
    """Fit on k-1 folds and calibrate on the held-out one, for every fold.

    ``sigmoid`` fits a logistic curve to the probability, ``isotonic`` a
    monotone function.
    """
    folded = stage(with_stratified_folds(df, KEY, LABEL, k, seed), "calibration-folds")
    models = fit_all(folded, features, [Fit(params, f"fold <> {i}") for i in range(k)])
    own = F.get(probability_column(models), F.col("fold")).alias("probability")
    return calibrate_scores(models, stage(folded.select(KEY, LABEL, "fold", own), "calibration"), method)


def calibrate_scores(models: Sequence[BoostedTrees], held_out: DataFrame, method: str = "sigmoid") -> Calibrated:
    """Calibrate fold models that are fitted already, on the rows (label, fold, probability) each did not see."""
    if method not in CALIBRATORS:
        raise ValueError(f"unknown calibration method {method!r}")
    made = [CALIBRATORS[method](held_out.where(F.col("fold") == i), "probability") for i in range(len(models))]
    return Calibrated(models, made, held_out)


LEARNING_SHARES = tuple(i / 10 for i in range(1, 11))


def learning_predictions(
    df: DataFrame,
    features: Sequence[str],
    params: S.BoostParams,
    shares: Sequence[float] = LEARNING_SHARES,
    k: int = 5,
    seed: int = 42,
) -> DataFrame:
    """(key, label, share, held_out fold, part, prediction), staged: the rows of every sample and of its held-out fold.

    A share keeps the training rows that hash below it, so every sample
    contains the smaller ones. All samples of all folds are fitted together.
    """
    folded = with_stratified_folds(df, KEY, LABEL, k, seed).withColumn("_u", unit_hash(KEY, seed + 1))
    folded = stage(folded, "learning-folds")
    cells = [(float(s), i) for s in shares for i in range(k)]
    models = fit_all(folded, features, [Fit(params, f"fold <> {i} and _u < {s!r}D") for s, i in cells])
    scored = folded.select(KEY, LABEL, "fold", "_u", probability_column(models).alias("s"))
    at = F.array(*[F.struct(F.lit(s).alias("share"), F.lit(i).alias("held_out"), F.get("s", F.lit(m)).alias("p")) for m, (s, i) in enumerate(cells)])
    each = scored.select(KEY, LABEL, "fold", "_u", F.inline(at))
    part = F.when(F.col("fold") == F.col("held_out"), "validation").when(F.col("_u") < F.col("share"), "train")
    return stage(
        each.withColumn("part", part).where("part is not null").select(
            KEY, LABEL, "share", "held_out", "part", (F.col("p") >= 0.5).cast("int").alias("prediction")
        ),
        "learning-predictions",
    )


def learning_curve(
    df: DataFrame,
    features: Sequence[str],
    params: S.BoostParams,
    shares: Sequence[float] = LEARNING_SHARES,
    k: int = 5,
    seed: int = 42,
) -> DataFrame:
    """(share, train and validation F1 mean and spread) over growing samples."""
    return curve_of(learning_predictions(df, features, params, shares, k, seed))


def curve_of(predictions: DataFrame) -> DataFrame:
    table = stage(M.hard_metrics(M.confusion(predictions, by=["share", "held_out", "part"]), ("f1",)), "learning-curve")
    side = {p: F.when(F.col("part") == p, F.col("f1")) for p in ("train", "validation")}
    return table.groupBy("share").agg(
        *[F.avg(c).alias(f"{p}_f1") for p, c in side.items()],
        *[F.stddev_pop(c).alias(f"{p}_f1_std") for p, c in side.items()],
    )
