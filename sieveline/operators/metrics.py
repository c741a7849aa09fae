"""Classification metrics from one aggregation pass.

Counts come first; every metric is a column expression over the four counts.
The same expressions therefore serve one table, folds, thresholds and weights.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline import settings as S
from sieveline.functions.expressions import count_above
from sieveline.operators.ranking import PART, running_counts

# Probabilities are kept this far from 0 and 1 in the log loss.
PROBABILITY_FLOOR = 2.220446049250313e-16


@dataclass(frozen=True)
class Counts:
    """Confusion counts as columns."""

    tp: Column
    tn: Column
    fp: Column
    fn: Column

    @classmethod
    def named(cls) -> "Counts":
        return cls(*[F.col(n).cast("double") for n in ("tp", "tn", "fp", "fn")])

    @property
    def total(self) -> Column:
        return self.tp + self.tn + self.fp + self.fn


def _share(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def accuracy(c: Counts) -> Column:
    return _share(c.tp + c.tn, c.total)


def precision(c: Counts) -> Column:
    return _share(c.tp, c.tp + c.fp)


def recall(c: Counts) -> Column:
    return _share(c.tp, c.tp + c.fn)


def specificity(c: Counts) -> Column:
    return _share(c.tn, c.tn + c.fp)


def f1(c: Counts) -> Column:
    return _share(F.lit(2.0) * c.tp, F.lit(2.0) * c.tp + c.fp + c.fn)


def matthews(c: Counts) -> Column:
    spread = (c.tp + c.fp) * (c.tp + c.fn) * (c.tn + c.fp) * (c.tn + c.fn)
    return _share(c.tp * c.tn - c.fp * c.fn, F.sqrt(spread))


def kappa(c: Counts) -> Column:
    observed = _share(c.tp + c.tn, c.total)
    chance = _share(
        (c.tp + c.fp) * (c.tp + c.fn) + (c.fn + c.tn) * (c.fp + c.tn), c.total * c.total
    )
    return _share(observed - chance, F.lit(1.0) - chance)


def balanced_accuracy(c: Counts) -> Column:
    return (recall(c) + specificity(c)) / F.lit(2.0)


HARD_METRICS = {
    "accuracy": accuracy,
    "precision": precision,
    "recall": recall,
    "f1": f1,
    "matthews_corr": matthews,
    "cohens_kappa": kappa,
    "balanced_accuracy": balanced_accuracy,
}


def confusion(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """tp, tn, fp, fn, one row (per group). Rows with a null are not counted."""
    y, p = F.col(label), F.col(prediction)
    return df.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    )


def confusion_metrics(counts: DataFrame) -> DataFrame:
    """The counts with specificity, sensitivity and both error rates."""
    c = Counts.named()
    return counts.withColumns(
        {
            "specificity": specificity(c),
            "sensitivity": recall(c),
            "fpr": _share(c.fp, c.fp + c.tn),
            "fnr": _share(c.fn, c.fn + c.tp),
        }
    )


def hard_metrics(counts: DataFrame, names: Sequence[str] = tuple(HARD_METRICS)) -> DataFrame:
    """Metrics of the counts next to the other columns of ``counts``."""
    c = Counts.named()
    keep = [n for n in counts.columns if n not in ("tp", "tn", "fp", "fn")]
    return counts.select(*keep, *[HARD_METRICS[n](c).alias(n) for n in names])


def business_cost(
    counts: DataFrame,
    cost_fp: float = S.COST_FALSE_POSITIVE,
    cost_fn: float = S.COST_FALSE_NEGATIVE,
) -> DataFrame:
    """Total and mean cost of the errors, with precision, recall and F1."""
    c = Counts.named()
    cost = c.fp * F.lit(cost_fp) + c.fn * F.lit(cost_fn)
    return counts.select(
        cost.alias("total_cost"),
        _share(cost, c.total).alias("cost_per_sample"),
        precision(c).alias("precision"),
        recall(c).alias("recall"),
        f1(c).alias("f1"),
        F.lit(cost_fp).alias("cost_fp"),
        F.lit(cost_fn).alias("cost_fn"),
    )


def error_rows(
    df: DataFrame, key: str, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """The misclassified rows with their kind. Stays distributed."""
    kind = F.when(F.col(prediction) == 1, "false_positive").otherwise("false_negative")
    return df.where(F.col(label) != F.col(prediction)).select(key, kind.alias("error"))


def error_summary(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    probability: str = "probability",
) -> DataFrame:
    """Error totals; the false-negative rate is over all rows."""
    wrong = F.col(label) != F.col(prediction)
    missed = (F.col(label) == 1) & (F.col(prediction) == 0)
    p = F.when(wrong, F.col(probability))
    return df.agg(
        F.count_if(wrong).alias("total_errors"),
        F.avg(wrong.cast("double")).alias("error_rate"),
        F.count_if((F.col(label) == 0) & (F.col(prediction) == 1)).alias("false_positives"),
        F.count_if(missed).alias("false_negatives"),
        F.avg(missed.cast("double")).alias("false_negative_rate"),
        F.avg(p).alias("mean_error_confidence"),
        F.min(p).alias("min_error_confidence"),
        F.max(p).alias("max_error_confidence"),
    )


def class_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, macro and weighted."""
    c = Counts.named()
    flipped = Counts(c.tn, c.tp, c.fn, c.fp)

    def line(name: str, side: Counts) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            precision(side).alias("precision"),
            recall(side).alias("recall"),
            f1(side).alias("f1"),
            (side.tp + side.fn).alias("support"),
        )

    both = counts.select(line("0", flipped).alias("a"), line("1", c).alias("b"))
    support = F.col("a.support") + F.col("b.support")

    def average(name: str, wa: Column, wb: Column) -> Column:
        parts = [
            (F.col(f"a.{m}") * wa + F.col(f"b.{m}") * wb).alias(m) for m in ("precision", "recall", "f1")
        ]
        return F.struct(F.lit(name).alias("class"), *parts, support.alias("support"))

    half = F.lit(0.5)
    rows = F.array(
        F.col("a"),
        F.col("b"),
        average("macro avg", half, half),
        average("weighted avg", _share(F.col("a.support"), support), _share(F.col("b.support"), support)),
    )
    return both.select(F.inline(rows)).select(
        "class",
        *[F.round(m, 4).alias(m) for m in ("precision", "recall", "f1")],
        F.col("support").cast("long").alias("support"),
    )


def probability_losses(
    df: DataFrame, label: str = "label", probability: str = "probability", by: Sequence[str] = ()
) -> DataFrame:
    """Log loss and Brier score."""
    y, p = F.col(label).cast("double"), F.col(probability)
    safe = F.greatest(F.least(p, F.lit(1.0 - PROBABILITY_FLOOR)), F.lit(PROBABILITY_FLOOR))
    loss = -(y * F.ln(safe) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - safe))
    return df.groupBy(*by).agg(
        F.avg(loss).alias("log_loss"), F.avg((p - y) * (p - y)).alias("brier_score")
    )


def score_counts(
    df: DataFrame, label: str = "label", probability: str = "probability", by: Sequence[str] = ()
) -> DataFrame:
    """Positives and negatives per distinct score with running totals."""
    y = F.col(label)
    return running_counts(
        df.where(y.isNotNull()),
        probability,
        {"pos": (y == 1).cast("long"), "neg": (y == 0).cast("long")},
        by,
    )


def auc(
    df: DataFrame, label: str = "label", probability: str = "probability", by: Sequence[str] = ()
) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null for one class."""
    counts = score_counts(df, label, probability, by)
    won = F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0))
    pairs = F.first("pos_total").cast("double") * F.first("neg_total").cast("double")
    return counts.groupBy(*by).agg(F.try_divide(F.sum(won), pairs).alias("auc"))


def _ends_of_parts(counts: DataFrame, value: str) -> DataFrame:
    """Each value's lower and upper neighbour counts, across partitions.

    Inside a partition a window finds them. The first and last rows of every
    partition form a table of one row per partition, which is windowed alone
    and broadcast.
    """
    inside = Window.partitionBy(PART).orderBy(value)
    here = F.struct("pos", "neg")
    edges = counts.groupBy(PART).agg(
        F.min_by(here, F.col(value)).alias("first"), F.max_by(here, F.col(value)).alias("last")
    )
    across = Window.orderBy(PART)
    edges = edges.select(
        PART,
        F.lag("last").over(across).alias("_part_below"),
        F.lead("first").over(across).alias("_part_above"),
    )
    return (
        counts.join(F.broadcast(edges), PART)
        .withColumn("below", F.coalesce(F.lag(here).over(inside), F.col("_part_below")))
        .withColumn("above", F.coalesce(F.lead(here).over(inside), F.col("_part_above")))
    )


def roc_curve(
    df: DataFrame,
    label: str = "label",
    probability: str = "probability",
    drop_collinear: bool = True,
) -> DataFrame:
    """(threshold, fpr, tpr), from (infinity, 0, 0) down to the smallest score.

    ``drop_collinear`` leaves out points on a straight line between their
    neighbours, as plotting needs no more.
    """
    counts = score_counts(df, label, probability)
    if drop_collinear:
        near = _ends_of_parts(counts, probability)
        # Walking down the scores, a point bends the curve when the step
        # after it differs from the step that reached it.
        bends = (F.col("below.pos") != F.col("pos")) | (F.col("below.neg") != F.col("neg"))
        ends = F.col("below").isNull() | F.col("above").isNull()
        counts = near.where(bends | ends)
    points = counts.select(
        F.col(probability).alias("threshold"),
        (F.col("neg_total") - F.col("neg_before")).alias("fp"),
        (F.col("pos_total") - F.col("pos_before")).alias("tp"),
        "neg_total",
        "pos_total",
    ).select(
        "threshold",
        F.try_divide("fp", "neg_total").alias("fpr"),
        F.try_divide("tp", "pos_total").alias("tpr"),
    )
    origin = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def pr_curve(df: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    """(threshold, precision, recall) per distinct score, ended by (null, 1, 0)."""
    counts = score_counts(df, label, probability)
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    points = counts.select(
        F.col(probability).alias("threshold"),
        _share(tp, tp + fp).alias("precision"),
        F.coalesce(F.try_divide(tp, F.col("pos_total")), F.lit(1.0)).alias("recall"),
    )
    last = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(last)


def calibration_curve(
    df: DataFrame, label: str = "label", probability: str = "probability", n_bins: int = 10
) -> DataFrame:
    """Mean score and mean label per right-closed equal bin; empty bins are absent."""
    edges = [i / n_bins for i in range(1, n_bins)]
    binned = df.select(
        count_above(probability, edges).alias("bin"),
        F.col(label).cast("double").alias("_y"),
        F.col(probability).alias("_p"),
    )
    return binned.where(F.col("_y").isNotNull() & F.col("_p").isNotNull()).groupBy("bin").agg(
        F.avg("_y").alias("prob_true"), F.avg("_p").alias("prob_pred"), F.count("*").alias("n")
    )


def calibration_error(curve: DataFrame, weighted: bool = False) -> DataFrame:
    """Mean gap between predicted and true share over the bins.

    Every bin counts the same unless ``weighted`` by its rows.
    """
    gap = F.abs(F.col("prob_pred") - F.col("prob_true"))
    error = F.try_divide(F.sum(gap * F.col("n")), F.sum("n")) if weighted else F.avg(gap)
    return curve.agg(error.alias("ece"))


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Negatives over positives, 1 when there are no positives."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    weight = F.when(pos > 0, F.try_divide(neg.cast("double"), pos.cast("double"))).otherwise(1.0)
    return df.agg(neg.alias("n_negative"), pos.alias("n_positive"), weight.alias("scale_pos_weight"))


def fold_summary(fold_metrics: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, mean, std) over the folds, population standard deviation."""
    long = fold_metrics.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [], list(metrics), "metric", "score"
    )
    return long.groupBy("metric").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count("score").alias("n_folds")
    )


def evaluation(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    probability: str = "probability",
) -> DataFrame:
    """One nested row: classification, confusion, errors, losses and cost."""
    counts = confusion(df, label, prediction)
    parts = {
        "classification": hard_metrics(counts),
        "confusion_matrix": confusion_metrics(counts),
        "error_analysis": error_summary(df, label, prediction, probability),
        "probability": probability_losses(df, label, probability),
        "ranking": auc(df, label, probability),
        "business_metrics": business_cost(counts),
    }
    row = df.sparkSession.range(1)
    return row.select(
        *[part.select(F.struct("*")).scalar().alias(name) for name, part in parts.items()]
    )
