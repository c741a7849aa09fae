"""Queries on metrics, curves, thresholds, splits and top-k lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.catalog.base import (
    SQL_COMPANIES,
    SQL_COUNTS,
    SQL_LABELS,
    SQL_SCORED,
    SQL_THREE,
    companies,
    labels,
    query,
    scored,
    three_scores,
    with_sql,
)
from sieveline.operators import metrics as M
from sieveline.operators import models as L
from sieveline.operators import splits as P
from sieveline.operators import summaries as A
from sieveline.operators import thresholds as T
from sieveline.operators.ranking import equal_width_histogram
from sieveline.sources.staging import stage


def _staged(spark, sf_dir):
    """The scored rows, staged for queries that pass over them more than once."""
    return stage(scored(spark, sf_dir), "scored")


def _rounded(df, digits=9, skip=()):
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" and c not in skip else c for c, t in df.dtypes]
    )


# --- predictions ---------------------------------------------------------------


@query(
    "prediction_table",
    with_sql(
        SQL_SCORED,
        """SELECT symbol, label AS shariah_compliant, prediction AS predicted_compliant,
  probability AS compliance_probability, 1 - probability AS non_compliance_probability,
  confidence, CAST(label = prediction AS INTEGER) AS prediction_correct
FROM scored""",
    ),
)
def prediction_table(spark, sf_dir):
    data = scored(spark, sf_dir).select("symbol", "label", "probability")
    return L.prediction_table(data)


@query(
    "prediction_statistics",
    with_sql(
        SQL_SCORED,
        """SELECT count(*) AS total_predictions, count(*) FILTER (prediction = 1) AS compliant_count,
  count(*) FILTER (prediction = 0) AS non_compliant_count, round(avg(prediction), 9) AS compliant_share,
  round(avg(confidence), 9) AS mean, round(stddev_pop(confidence), 9) AS std_dev, round(min(confidence), 9) AS min,
  round(max(confidence), 9) AS max, round(quantile_cont(confidence, 0.25), 9) AS p25,
  round(quantile_cont(confidence, 0.5), 9) AS median, round(quantile_cont(confidence, 0.75), 9) AS p75 FROM scored""",
    ),
)
def prediction_statistics(spark, sf_dir):
    return _rounded(A.prediction_statistics(_staged(spark, sf_dir), "prediction"))


_LEFT = (
    ("50-60%", "confidence >= 0.5 AND confidence < 0.6"),
    ("60-70%", "confidence >= 0.6 AND confidence < 0.7"),
    ("70-80%", "confidence >= 0.7 AND confidence < 0.8"),
    ("80-90%", "confidence >= 0.8 AND confidence < 0.9"),
    ("90-100%", "confidence >= 0.9"),
)
_RIGHT = tuple(
    (name, f"confidence > {lo} AND confidence <= {hi}")
    for (name, _), lo, hi in zip(_LEFT, (0.5, 0.6, 0.7, 0.8, 0.9), (0.6, 0.7, 0.8, 0.9, 1.0))
)


def _bands(rules) -> str:
    return "\nUNION ALL\n".join(f"SELECT '{n}' AS band, count(*) FILTER ({c}) AS n FROM scored" for n, c in rules)


@query("confidence_bands", with_sql(SQL_SCORED, _bands(_LEFT)))
def confidence_bands(spark, sf_dir):
    return A.confidence_histogram(scored(spark, sf_dir))


@query("confidence_bands_right_closed", with_sql(SQL_SCORED, _bands(_RIGHT)))
def confidence_bands_right_closed(spark, sf_dir):
    return A.confidence_histogram(scored(spark, sf_dir), right_closed=True)


@query(
    "asset_histogram",
    with_sql(
        SQL_COMPANIES,
        """, ends AS (SELECT min(total_assets) AS lo, max(total_assets) AS hi FROM companies)
SELECT CAST(least(floor((total_assets - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS n
FROM companies, ends WHERE total_assets IS NOT NULL GROUP BY 1""",
    ).replace("\n, ends", ",\nends"),
)
def asset_histogram(spark, sf_dir):
    return equal_width_histogram(companies(spark, sf_dir), "total_assets", 30)


# --- classification metrics ------------------------------------------------------


@query(
    "confusion_matrix",
    with_sql(
        SQL_COUNTS,
        """SELECT CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
  round(tn / (tn + fp), 9) AS specificity, round(tp / (tp + fn), 9) AS sensitivity,
  round(fp / (fp + tn), 9) AS fpr, round(fn / (fn + tp), 9) AS fnr FROM counts""",
    ),
)
def confusion_matrix(spark, sf_dir):
    return _rounded(M.confusion_metrics(M.confusion(scored(spark, sf_dir))))


SQL_METRICS = """SELECT round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round(tp / (tp + fp), 9) AS precision,
  round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1,
  round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS matthews_corr,
  round(((tp + tn) / (tp + tn + fp + fn)
      - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + tn + fp + fn) * (tp + tn + fp + fn)))
    / (1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + tn + fp + fn) * (tp + tn + fp + fn))), 9)
    AS cohens_kappa,
  round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy FROM counts"""


@query("classification_metrics", with_sql(SQL_COUNTS, SQL_METRICS))
def classification_metrics(spark, sf_dir):
    return _rounded(M.hard_metrics(M.confusion(scored(spark, sf_dir))))


@query(
    "error_summary",
    with_sql(
        SQL_SCORED,
        """SELECT count(*) FILTER (label <> prediction) AS total_errors,
  round(avg(CAST(label <> prediction AS INTEGER)), 9) AS error_rate,
  count(*) FILTER (label = 0 AND prediction = 1) AS false_positives,
  count(*) FILTER (label = 1 AND prediction = 0) AS false_negatives,
  round(avg(CAST(label = 1 AND prediction = 0 AS INTEGER)), 9) AS false_negative_rate,
  round(avg(probability) FILTER (label <> prediction), 9) AS mean_error_confidence,
  min(probability) FILTER (label <> prediction) AS min_error_confidence,
  max(probability) FILTER (label <> prediction) AS max_error_confidence FROM scored""",
    ),
)
def error_summary(spark, sf_dir):
    return _rounded(M.error_summary(scored(spark, sf_dir)))


@query(
    "error_rows",
    with_sql(
        SQL_SCORED,
        """SELECT company_id, CASE WHEN prediction = 1 THEN 'false_positive' ELSE 'false_negative' END AS error
FROM scored WHERE label <> prediction""",
    ),
)
def error_rows(spark, sf_dir):
    return M.error_rows(scored(spark, sf_dir), "company_id")


@query(
    "business_cost",
    with_sql(
        SQL_COUNTS,
        """SELECT fp * 1.0 + fn * 5.0 AS total_cost, round((fp * 1.0 + fn * 5.0) / (tp + tn + fp + fn), 9)
  AS cost_per_sample, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 9) AS f1, 1.0::DOUBLE AS cost_fp, 5.0::DOUBLE AS cost_fn FROM counts""",
    ),
)
def business_cost(spark, sf_dir):
    return _rounded(M.business_cost(M.confusion(scored(spark, sf_dir))))


@query(
    "class_report",
    with_sql(
        SQL_COUNTS,
        """, per AS (
  SELECT '0' AS class, tn / (tn + fn) AS precision, tn / (tn + fp) AS recall, 2 * tn / (2 * tn + fn + fp) AS f1,
    tn + fp AS support FROM counts
  UNION ALL
  SELECT '1', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM counts)
SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1,
  CAST(support AS BIGINT) AS support FROM per
UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4),
  CAST(sum(support) AS BIGINT) FROM per
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4),
  round(sum(recall * support) / sum(support), 4), round(sum(f1 * support) / sum(support), 4),
  CAST(sum(support) AS BIGINT) FROM per""",
    ).replace("\n, per", ",\nper"),
)
def class_report(spark, sf_dir):
    return M.class_report(M.confusion(scored(spark, sf_dir)))


_SAFE = "greatest(least(probability, 1 - 2.220446049250313e-16::DOUBLE), 2.220446049250313e-16::DOUBLE)"
_LOSS = f"round(-avg(label * ln({_SAFE}) + (1 - label) * ln(1 - {_SAFE})), 9)"


@query(
    "probability_losses",
    with_sql(
        SQL_SCORED,
        f"SELECT {_LOSS} AS log_loss, round(avg((probability - label) * (probability - label)), 9) AS brier_score "
        "FROM scored",
    ),
)
def probability_losses(spark, sf_dir):
    return _rounded(M.probability_losses(scored(spark, sf_dir)))


SQL_AUC = """SELECT round((sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0)
  / (sum(label) * sum(1 - label)), 9) AS auc FROM (
  SELECT label, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2.0 AS r
  FROM scored)"""


@query("roc_auc", with_sql(SQL_SCORED, SQL_AUC))
def roc_auc(spark, sf_dir):
    return _rounded(M.auc(scored(spark, sf_dir)))


SQL_STEPS = SQL_SCORED + """,
steps AS (
  SELECT probability AS threshold, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg
  FROM scored GROUP BY 1),
walk AS (
  SELECT threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER () AS p, sum(neg) OVER () AS n,
    lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, lag(pos) OVER w AS last_pos
  FROM steps WINDOW w AS (ORDER BY threshold DESC))"""


@query(
    "roc_curve",
    with_sql(
        SQL_STEPS,
        """SELECT threshold, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM walk
WHERE last_pos IS NULL OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
UNION ALL SELECT 'infinity'::DOUBLE, 0, 0""",
    ),
)
def roc_curve(spark, sf_dir):
    return _rounded(M.roc_curve(scored(spark, sf_dir)), skip=("threshold",))


@query(
    "roc_curve_all_points",
    with_sql(
        SQL_STEPS,
        """SELECT threshold, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM walk
UNION ALL SELECT 'infinity'::DOUBLE, 0, 0""",
    ),
)
def roc_curve_all_points(spark, sf_dir):
    return _rounded(M.roc_curve(scored(spark, sf_dir), drop_collinear=False), skip=("threshold",))


@query(
    "precision_recall_curve",
    with_sql(
        SQL_STEPS,
        """SELECT threshold, round(tp / (tp + fp), 9) AS precision, round(tp / p, 9) AS recall FROM walk
UNION ALL SELECT NULL, 1, 0""",
    ),
)
def precision_recall_curve(spark, sf_dir):
    return _rounded(M.pr_curve(scored(spark, sf_dir)), skip=("threshold",))


SQL_BINS = SQL_SCORED + """,
bins AS (
  SELECT CAST(probability > 0.1 AS INTEGER) + CAST(probability > 0.2 AS INTEGER) + CAST(probability > 0.3 AS INTEGER)
    + CAST(probability > 0.4 AS INTEGER) + CAST(probability > 0.5 AS INTEGER) + CAST(probability > 0.6 AS INTEGER)
    + CAST(probability > 0.7 AS INTEGER) + CAST(probability > 0.8 AS INTEGER) + CAST(probability > 0.9 AS INTEGER)
    AS bin, avg(label) AS prob_true, avg(probability) AS prob_pred, count(*) AS n
  FROM scored GROUP BY 1)"""


@query(
    "calibration_curve",
    with_sql(
        SQL_BINS, "SELECT bin, round(prob_true, 9) AS prob_true, round(prob_pred, 9) AS prob_pred, n FROM bins"
    ),
)
def calibration_curve(spark, sf_dir):
    return _rounded(M.calibration_curve(scored(spark, sf_dir)))


@query(
    "calibration_error",
    with_sql(
        SQL_BINS,
        """SELECT round(avg(abs(prob_pred - prob_true)), 9) AS ece,
  round(sum(abs(prob_pred - prob_true) * n) / sum(n), 9) AS weighted_ece FROM bins""",
    ),
)
def calibration_error(spark, sf_dir):
    curve = stage(M.calibration_curve(scored(spark, sf_dir)), "calibration")
    weighted = M.calibration_error(curve, weighted=True).scalar()
    return _rounded(M.calibration_error(curve).withColumn("weighted_ece", weighted))


@query(
    "class_weight",
    with_sql(
        SQL_LABELS,
        """SELECT count(*) FILTER (shariah_compliant = 0) AS n_negative, count(*) FILTER (shariah_compliant = 1)
  AS n_positive, round(count(*) FILTER (shariah_compliant = 0) / count(*) FILTER (shariah_compliant = 1), 9)
  AS scale_pos_weight FROM labels""",
    ),
)
def class_weight(spark, sf_dir):
    return _rounded(M.class_weight(labels(spark, sf_dir), "shariah_compliant"))


@query(
    "evaluation_bundle",
    with_sql(
        SQL_COUNTS,
        f"""SELECT CAST(tp AS BIGINT) AS tp, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy,
  round(tn / (tn + fp), 9) AS specificity, CAST(fp + fn AS BIGINT) AS total_errors, fp + 5 * fn AS total_cost,
  (SELECT {_LOSS} FROM scored) AS log_loss, ({SQL_AUC}) AS auc FROM counts""",
    ),
)
def evaluation_bundle(spark, sf_dir):
    bundle = M.evaluation(_staged(spark, sf_dir))
    return bundle.select(
        F.col("confusion_matrix.tp").alias("tp"),
        F.round("classification.accuracy", 9).alias("accuracy"),
        F.round("confusion_matrix.specificity", 9).alias("specificity"),
        F.col("error_analysis.total_errors").alias("total_errors"),
        F.col("business_metrics.total_cost").alias("total_cost"),
        F.round("probability.log_loss", 9).alias("log_loss"),
        F.round("ranking.auc", 9).alias("auc"),
    )


# --- splits and folds --------------------------------------------------------------

UNIT = "CAST(('0x' || substr(md5(CAST(company_id AS VARCHAR) || '|42'), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496"


@query(
    "stratified_split",
    with_sql(
        SQL_LABELS,
        f"SELECT company_id, shariah_compliant, CAST({UNIT} < 0.2 AS INTEGER) AS is_test FROM labels",
    ),
)
def stratified_split(spark, sf_dir):
    keyed = labels(spark, sf_dir).select(F.col("symbol").cast("long").alias("company_id"), "shariah_compliant")
    split = P.with_split(keyed, "company_id")
    return split.withColumn("is_test", F.col("is_test").cast("int"))


@query(
    "stratified_split_exact",
    with_sql(
        SQL_LABELS,
        f"""SELECT company_id, shariah_compliant, CAST(row_number() OVER (PARTITION BY shariah_compliant ORDER BY u, company_id)
  <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY shariah_compliant)) AS INTEGER) AS is_test
FROM (SELECT *, {UNIT} AS u FROM labels)""",
    ),
)
def stratified_split_exact(spark, sf_dir):
    keyed = stage(
        labels(spark, sf_dir).select(F.col("symbol").cast("long").alias("company_id"), "shariah_compliant"), "keyed"
    )
    split = P.with_exact_split(keyed, "company_id", "shariah_compliant")
    return split.select("company_id", "shariah_compliant", F.col("is_test").cast("int").alias("is_test"))


@query(
    "fold_assignment",
    with_sql(
        SQL_LABELS,
        f"SELECT CAST(floor({UNIT} * 5) AS INTEGER) AS fold, shariah_compliant, count(*) AS n FROM labels GROUP BY ALL",
    ),
)
def fold_assignment(spark, sf_dir):
    keyed = labels(spark, sf_dir).select(F.col("symbol").alias("company_id"), "shariah_compliant")
    return P.with_folds(keyed, "company_id").groupBy("fold", "shariah_compliant").agg(F.count("*").alias("n"))


@query(
    "stratified_folds",
    with_sql(
        SQL_LABELS,
        f"""SELECT company_id, shariah_compliant, CAST((row_number() OVER (PARTITION BY shariah_compliant ORDER BY u, company_id) - 1) % 5
  AS INTEGER) AS fold FROM (SELECT *, {UNIT} AS u FROM labels)""",
    ),
)
def stratified_folds(spark, sf_dir):
    """Every class is dealt round robin in the order of its hashes."""
    keyed = stage(
        labels(spark, sf_dir).select(F.col("symbol").cast("long").alias("company_id"), "shariah_compliant"), "keyed"
    )
    return P.with_stratified_folds(keyed, "company_id", "shariah_compliant")


_FOLD_METRICS = ("accuracy", "precision", "recall", "f1")


@query(
    "fold_summary",
    with_sql(
        SQL_SCORED,
        f""", per_fold AS (
  SELECT CAST(floor({UNIT} * 5) AS INTEGER) AS fold, avg(CAST(label = prediction AS INTEGER)) AS accuracy,
    count(*) FILTER (label = 1 AND prediction = 1) / count(*) FILTER (prediction = 1) AS precision,
    count(*) FILTER (label = 1 AND prediction = 1) / count(*) FILTER (label = 1) AS recall,
    2 * count(*) FILTER (label = 1 AND prediction = 1)
      / (count(*) FILTER (label = 1) + count(*) FILTER (prediction = 1)) AS f1
  FROM scored GROUP BY 1)
"""
        + "\nUNION ALL\n".join(
            f"SELECT '{m}' AS metric, round(avg({m}), 9) AS mean, round(stddev_pop({m}), 9) AS std, "
            f"count({m}) AS n_folds FROM per_fold"
            for m in _FOLD_METRICS
        ),
    ).replace("\n, per_fold", ",\nper_fold"),
)
def fold_summary(spark, sf_dir):
    folded = P.with_folds(scored(spark, sf_dir), "company_id")
    per_fold = M.hard_metrics(M.confusion(folded, by=["fold"]), _FOLD_METRICS)
    return _rounded(M.fold_summary(per_fold, _FOLD_METRICS))


@query(
    "nested_samples",
    with_sql(
        SQL_LABELS,
        "\nUNION ALL\n".join(
            f"SELECT {s}::DOUBLE AS share, count(*) AS n, CAST(sum(shariah_compliant) AS BIGINT) AS n_compliant "
            f"FROM labels WHERE {UNIT} < {s}"
            for s in (0.1, 0.5, 1.0)
        ),
    ),
)
def nested_samples(spark, sf_dir):
    keyed = labels(spark, sf_dir).select(F.col("symbol").alias("company_id"), "shariah_compliant")
    parts = [
        A.sampled(keyed, s, "company_id").agg(
            F.lit(s).alias("share"), F.count("*").alias("n"), F.sum("shariah_compliant").alias("n_compliant")
        )
        for s in (0.1, 0.5, 1.0)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- thresholds, votes and blends ----------------------------------------------------

SQL_GRID = """SELECT threshold,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round((tp + tn) / (tp + tn + fp + fn), 9)
    AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall FROM (
  SELECT threshold, CAST(count(*) FILTER (label = 1 AND probability >= threshold) AS DOUBLE) AS tp,
    CAST(count(*) FILTER (label = 0 AND probability < threshold) AS DOUBLE) AS tn,
    CAST(count(*) FILTER (label = 0 AND probability >= threshold) AS DOUBLE) AS fp,
    CAST(count(*) FILTER (label = 1 AND probability < threshold) AS DOUBLE) AS fn
  FROM scored, ({grid}) GROUP BY threshold)"""
_SEARCH = "SELECT i / 100 AS threshold FROM range(10, 95, 5) t(i)"
_EVEN = "SELECT unnest([" + ", ".join(f"{t!r}::DOUBLE" for t in T.even_grid(0.3, 0.7, 20)) + "]) AS threshold"


@query("threshold_table", with_sql(SQL_SCORED, SQL_GRID.format(grid=_SEARCH)))
def threshold_table(spark, sf_dir):
    return _rounded(T.threshold_metrics(scored(spark, sf_dir)), skip=("threshold",))


@query(
    "threshold_search",
    with_sql(
        SQL_SCORED,
        f"SELECT threshold, f1 FROM ({SQL_GRID.format(grid=_SEARCH)}) ORDER BY f1 DESC, threshold LIMIT 1",
    ),
)
def threshold_search(spark, sf_dir):
    return _rounded(T.best_threshold(T.threshold_metrics(scored(spark, sf_dir))), skip=("threshold",))


@query("threshold_robustness", with_sql(SQL_SCORED, SQL_GRID.format(grid=_EVEN)))
def threshold_robustness(spark, sf_dir):
    return _rounded(
        T.threshold_metrics(scored(spark, sf_dir), T.even_grid(0.3, 0.7, 20)), skip=("threshold",)
    )


@query(
    "soft_and_hard_votes",
    with_sql(
        SQL_THREE,
        """SELECT company_id, round((p1 + p2 + p3) / 3, 9) AS soft, round((0.5 * p1 + 0.3 * p2 + 0.2 * p3), 9)
  AS weighted, CAST(CAST(p1 >= 0.5 AS INTEGER) + CAST(p2 >= 0.5 AS INTEGER) + CAST(p3 >= 0.5 AS INTEGER) >= 2
  AS INTEGER) AS hard FROM three""",
    ),
)
def soft_and_hard_votes(spark, sf_dir):
    names = ["p1", "p2", "p3"]
    return three_scores(spark, sf_dir).select(
        "company_id",
        F.round(T.soft_vote(names), 9).alias("soft"),
        F.round(T.soft_vote(names, [0.5, 0.3, 0.2]), 9).alias("weighted"),
        T.hard_vote(names).alias("hard"),
    )


SQL_BLEND = SQL_THREE + """,
triples AS (
  SELECT row_number() OVER (ORDER BY a, b) - 1 AS candidate, a / 10 AS w1, b / 10 AS w2, (10 - a - b) / 10 AS w3
  FROM range(0, 11) x(a), range(0, 10) y(b) WHERE a + b < 10),
hits AS (
  SELECT candidate, w1, w2, w3, label, w1 * p1 + w2 * p2 + w3 * p3 >= 0.5::DOUBLE - 1e-12 AS hit FROM three, triples),
blends AS (
  SELECT candidate, w1, w2, w3, round(coalesce(2 * count(*) FILTER (hit AND label = 1)
    / nullif(count(*) FILTER (hit) + count(*) FILTER (label = 1), 0), 0), 9) AS f1 FROM hits GROUP BY ALL)"""


@query(
    "blend_weight_table",
    with_sql(SQL_BLEND, "SELECT CAST(candidate AS INTEGER) AS candidate, w1, w2, w3, f1 FROM blends"),
)
def blend_weight_table(spark, sf_dir):
    table = T.blend_scores(three_scores(spark, sf_dir), ["p1", "p2", "p3"])
    return table.select("candidate", "w1", "w2", "w3", F.round("f1", 9).alias("f1"))


@query(
    "blend_weights",
    with_sql(SQL_BLEND, "SELECT w1, w2, w3, f1 FROM blends ORDER BY f1 DESC, candidate LIMIT 1"),
)
def blend_weights(spark, sf_dir):
    best = T.best_blend(T.blend_scores(three_scores(spark, sf_dir), ["p1", "p2", "p3"]))
    return best.withColumn("f1", F.round("f1", 9))


# --- top-k -------------------------------------------------------------------------------


def _predictions(spark, sf_dir):
    return scored(spark, sf_dir).withColumnRenamed("prediction", "predicted_compliant")


@query(
    "most_confident_compliant",
    with_sql(
        SQL_SCORED,
        "SELECT symbol, confidence FROM scored WHERE prediction = 1 ORDER BY confidence DESC, symbol LIMIT 15",
    ),
)
def most_confident_compliant(spark, sf_dir):
    return A.most_confident(_predictions(spark, sf_dir))


@query(
    "least_confident_non_compliant",
    with_sql(
        SQL_SCORED,
        """SELECT symbol, confidence, 1 - confidence AS risk_score FROM scored WHERE prediction = 0
ORDER BY confidence, symbol LIMIT 15""",
    ),
)
def least_confident_non_compliant(spark, sf_dir):
    return A.least_confident_rejections(_predictions(spark, sf_dir))


@query(
    "prediction_preview",
    with_sql(SQL_SCORED, "SELECT symbol, prediction, confidence FROM scored ORDER BY symbol LIMIT 10"),
)
def prediction_preview(spark, sf_dir):
    return A.preview(scored(spark, sf_dir).select("symbol", "prediction", "confidence"))


@query(
    "extreme_probabilities",
    with_sql(
        SQL_SCORED,
        """(SELECT 'highest' AS side, symbol, probability FROM scored ORDER BY probability DESC, symbol LIMIT 10)
UNION ALL
(SELECT 'lowest', symbol, probability FROM scored ORDER BY probability, symbol LIMIT 10)""",
    ),
)
def extreme_probabilities(spark, sf_dir):
    return A.extreme_probabilities(scored(spark, sf_dir))


@query(
    "example_rows",
    with_sql(
        SQL_SCORED,
        """SELECT 'correct_compliant' AS example, min(company_id) AS company_id FROM scored
WHERE label = 1 AND prediction = 1
UNION ALL SELECT 'correct_non_compliant', min(company_id) FROM scored WHERE label = 0 AND prediction = 0
UNION ALL (SELECT 'least_confident', company_id FROM scored ORDER BY confidence, company_id LIMIT 1)""",
    ),
)
def example_rows(spark, sf_dir):
    return A.exemplars(scored(spark, sf_dir))
