"""Queries on labels, decisions, guardrails and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.catalog.base import (
    DEPLOYMENT,
    GUARDRAILS,
    LABEL_RULES,
    SCREENING_RULES,
    SQL_COMPANIES,
    SQL_COUNTS,
    SQL_FEATURES,
    SQL_LABELS,
    SQL_SCORED,
    features,
    labels,
    query,
    scored,
    with_sql,
)
from sieveline.operators import guardrails as G
from sieveline.operators import metrics as M
from sieveline.operators import screening as D
from sieveline.operators import summaries as A
from sieveline.operators.labeling import RULE_FLAGS, label_companies, with_sector_rule
from sieveline.operators.reshape import attach_sector
from sieveline.plans.jobs import permit_decisions, portfolio_summary, screen_portfolio
from sieveline.plans.star_schema import companies, sector_map, table
from sieveline.sources.staging import stage

_INPUTS = (
    "ticker",
    "company_name",
    "sector",
    "total_assets",
    "total_liabilities",
    "nonhalal_revenue_percent",
    "net_income",
    "interest_expense",
)


def portfolio(spark, sf_dir):
    """The rule engine's input: amounts as reported, nulls included."""
    return companies(spark, sf_dir).withColumnRenamed("symbol", "ticker").select(*_INPUTS)


def decisions(spark, sf_dir, keep=()):
    return D.screen(portfolio(spark, sf_dir), SCREENING_RULES, keep=keep)


@query(
    "label_sector_rule",
    "SELECT CAST(c_custkey AS VARCHAR) AS symbol, CASE WHEN c_custkey % 50 <> 0 AND c_mktsegment = 'HOUSEHOLD' "
    "THEN 0 ELSE 1 END AS sector_compliant FROM customer",
)
def label_sector_rule(spark, sf_dir):
    symbols = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("symbol"))
    ruled = with_sector_rule(attach_sector(symbols, sector_map(spark, sf_dir)), LABEL_RULES)
    return ruled.select("symbol", "sector_compliant")


_LABEL_COLUMNS = f"""symbol, coalesce(sector, 'Other') AS sector, sector_compliant, financial_compliant,
  shariah_compliant, {', '.join(f'CAST({f} AS INTEGER) AS {f}' for f in RULE_FLAGS)},
  debt_to_assets AS debt_to_assets_value, f_nonhalal AS interest_income_value,
  f_riba AS interest_bearing_debt_value, roa AS roa_value, equity_ratio_value"""


@query("compliance_labels", with_sql(SQL_LABELS, f"SELECT {_LABEL_COLUMNS} FROM labels"))
def compliance_labels(spark, sf_dir):
    named = attach_sector(features(spark, sf_dir), sector_map(spark, sf_dir))
    made = label_companies(named, LABEL_RULES)
    return made.withColumns({f: F.col(f).cast("int") for f in RULE_FLAGS})


@query(
    "financial_rules_raw",
    with_sql(
        SQL_COMPANIES,
        """SELECT symbol,
  CASE WHEN nonhalal_revenue_percent <= 0.10 THEN 1 ELSE 0 END AS interest_income_ok,
  CASE WHEN net_income / (total_assets + 1e-5) >= -0.10 THEN 1 ELSE 0 END AS profitability_ok,
  CASE WHEN total_equity / (total_assets + 1e-5) >= -0.20 THEN 1 ELSE 0 END AS equity_ok,
  0 AS debt_to_assets_ok, net_income / (total_assets + 1e-5) AS roa_value FROM companies""",
    ),
)
def financial_rules_raw(spark, sf_dir):
    made = label_companies(companies(spark, sf_dir), LABEL_RULES)
    flags = ("interest_income_ok", "profitability_ok", "equity_ok", "debt_to_assets_ok")
    return made.select("symbol", *[F.col(f).cast("int").alias(f) for f in flags], "roa_value")


@query(
    "label_summary",
    with_sql(
        SQL_LABELS,
        """SELECT count(*) AS total_companies, CAST(sum(shariah_compliant) AS BIGINT) AS compliant,
  CAST(count(*) - sum(shariah_compliant) AS BIGINT) AS non_compliant,
  round(avg(shariah_compliant) * 100, 8) AS compliant_pct FROM labels""",
    ),
)
def label_summary(spark, sf_dir):
    return A.label_summary(labels(spark, sf_dir)).withColumn("compliant_pct", F.round("compliant_pct", 8))


@query(
    "compliance_by_sector",
    with_sql(
        SQL_LABELS,
        """SELECT coalesce(sector, 'Other') AS sector, count(*) AS n_companies,
  CAST(sum(shariah_compliant) AS BIGINT) AS n_compliant,
  round(avg(shariah_compliant), 9) AS compliant_share FROM labels GROUP BY 1""",
    ),
)
def compliance_by_sector(spark, sf_dir):
    named = attach_sector(features(spark, sf_dir), sector_map(spark, sf_dir))
    table_ = A.by_sector(label_companies(named, LABEL_RULES))
    return table_.withColumn("compliant_share", F.round("compliant_share", 9))


@query(
    "compliance_by_sector_total",
    with_sql(
        SQL_LABELS,
        """SELECT sector, count(*) AS n_companies, CAST(sum(shariah_compliant) AS BIGINT) AS n_compliant,
  round(avg(shariah_compliant), 9) AS compliant_share, CAST(grouping(sector) AS INTEGER) AS is_total
FROM labels GROUP BY ROLLUP (sector)""",
    ),
)
def compliance_by_sector_total(spark, sf_dir):
    table_ = A.by_sector(labels(spark, sf_dir), total=True)
    return table_.withColumn("compliant_share", F.round("compliant_share", 9))


@query(
    "failure_reasons",
    with_sql(
        SQL_LABELS,
        "SELECT 'sector' AS rule, count(*) FILTER (sector_compliant = 0) AS n_failed FROM labels"
        + "".join(
            f"\nUNION ALL SELECT '{f}', count(*) FILTER (NOT {f}) FROM labels" for f in RULE_FLAGS
        ),
    ),
)
def failure_reasons(spark, sf_dir):
    return A.failure_reasons(labels(spark, sf_dir))


SQL_DECISIONS = SQL_COMPANIES + """,
facts AS (
  SELECT symbol AS ticker, company_name, sector,
    contains(coalesce(trim(sector), 'nan'), 'HOUSE') OR contains(coalesce(trim(sector), 'nan'), 'Gambling') AS haram,
    total_liabilities / nullif(total_assets, 0) AS debt, nonhalal_revenue_percent AS income,
    total_assets IS NULL OR total_assets = 0 OR total_liabilities IS NULL OR sector IS NULL
      OR nonhalal_revenue_percent IS NULL OR net_income IS NULL OR interest_expense IS NULL
      OR company_name IS NULL AS incomplete
  FROM companies),
tested AS (
  SELECT *, coalesce(debt < 0.45, false) AS debt_ok, coalesce(income < 0.10, false) AS income_ok,
    CASE WHEN debt >= 0.40 AND debt < 0.45
      THEN 'Borderline debt ratio: ' || printf('%.1f%%', debt * 100) || ' (warning zone: 40%-48%)' END AS z1,
    CASE WHEN income >= 0.07 AND income < 0.10
      THEN 'Borderline non-halal income: ' || printf('%.1f%%', income * 100) || ' (warning zone: 7%-13%)' END AS z2,
    CASE WHEN incomplete THEN 'Incomplete or noisy financial data' END AS z3
  FROM facts),
decided AS (
  SELECT *,
    CASE WHEN haram OR NOT debt_ok OR NOT income_ok THEN 'NON_COMPLIANT'
      WHEN z1 IS NOT NULL OR z2 IS NOT NULL OR z3 IS NOT NULL THEN 'EDGE_CASE' ELSE 'COMPLIANT' END AS status,
    CASE WHEN haram THEN 'HARAM_SECTOR' WHEN NOT debt_ok THEN 'EXCESSIVE_DEBT'
      WHEN NOT income_ok THEN 'EXCESSIVE_NONHALAL'
      WHEN z1 IS NOT NULL OR z2 IS NOT NULL OR z3 IS NOT NULL THEN 'AMBIGUOUS' ELSE 'None' END AS violations
  FROM tested)"""


@query(
    "decision_table",
    with_sql(
        SQL_DECISIONS,
        """SELECT ticker, company_name, status, 1.0::DOUBLE AS final_confidence, NULL::DOUBLE AS ml_score, violations
FROM decided""",
    ),
)
def decision_table(spark, sf_dir):
    return D.flat_decisions(decisions(spark, sf_dir))


@query(
    "decision_reasons",
    with_sql(
        SQL_DECISIONS,
        """SELECT ticker, status,
  CASE WHEN haram THEN 'Operates in haram sector: ' || coalesce(sector, 'nan')
    WHEN NOT debt_ok THEN 'Excessive debt exposure: ' || coalesce(printf('%.1f%%', debt * 100), 'nan%') || ' > 45.0%'
    WHEN NOT income_ok THEN 'Excessive non-halal income: ' || coalesce(printf('%.1f%%', income * 100), 'nan%')
      || ' > 10.0%'
    ELSE concat_ws(' | ', z1, z2, z3) END AS risk_factors,
  CASE WHEN status = 'COMPLIANT' THEN 'Passes all hard Shariah rules | Debt ratio: ' || printf('%.1f%%', debt * 100)
    || ' < 45.0% | Non-halal income: ' || printf('%.1f%%', income * 100) || ' < 10.0%'
    ELSE '' END AS supporting_factors
FROM decided""",
    ),
)
def decision_reasons(spark, sf_dir):
    return decisions(spark, sf_dir).select(
        "ticker",
        "status",
        F.array_join("risk_factors", " | ").alias("risk_factors"),
        F.array_join("supporting_factors", " | ").alias("supporting_factors"),
    )


@query(
    "decision_rule_trace",
    with_sql(
        SQL_DECISIONS,
        """SELECT ticker, 0 AS position, 'Haram Sector' AS rule, CAST(NOT haram AS INTEGER) AS passed,
  CASE WHEN haram THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value, 0.0::DOUBLE AS threshold, 'CRITICAL' AS severity,
  'Sector: ' || coalesce(trim(sector), 'nan') || CASE WHEN haram THEN ' (HARAM)' ELSE ' (Permissible)' END
    AS explanation
FROM decided
UNION ALL
SELECT ticker, 1, 'F_RIBA (Debt-to-Assets)', CAST(debt_ok AS INTEGER), round(debt, 4), 0.45, 'CRITICAL',
  'Debt exposure ' || coalesce(printf('%.1f%%', debt * 100), 'nan%') || CASE WHEN debt_ok THEN ' < ' ELSE ' ≥ ' END
    || '45%' FROM decided WHERE NOT haram
UNION ALL
SELECT ticker, 2, 'F_NONHALAL (Income Purity)', CAST(income_ok AS INTEGER), round(income, 4), 0.10, 'CRITICAL',
  'Non-halal income ' || coalesce(printf('%.1f%%', income * 100), 'nan%')
    || CASE WHEN income_ok THEN ' < ' ELSE ' ≥ ' END || '10%' FROM decided WHERE NOT haram AND debt_ok""",
    ),
)
def decision_rule_trace(spark, sf_dir):
    trace = D.rule_trace(decisions(spark, sf_dir))
    return trace.withColumn("passed", F.col("passed").cast("int"))


@query(
    "decision_status_counts",
    with_sql(
        SQL_DECISIONS,
        "SELECT status, count(*) AS n, round(count(*) / (SELECT count(*) FROM decided), 9) AS share "
        "FROM decided GROUP BY status",
    ),
)
def decision_status_counts(spark, sf_dir):
    counts = A.value_counts(decisions(spark, sf_dir), "status")
    return counts.withColumn("share", F.round("share", 9))


@query(
    "violation_counts",
    with_sql(
        SQL_DECISIONS,
        "SELECT CAST(violations <> 'None' AS INTEGER) AS n_violations, count(*) AS n FROM decided GROUP BY 1",
    ),
)
def violation_counts(spark, sf_dir):
    per_company = D.violation_counts(decisions(spark, sf_dir))
    return per_company.groupBy("n_violations").agg(F.count("*").alias("n"))


_IMPORTANCE = (("debt_to_assets", 0.61), ("f_nonhalal", 0.35), ("roa", 0.04))
_P = "round(1 / (1 + exp(-(3.0 - 5.0 * debt - 8.0 * income))), 2)"


def hybrid(spark, sf_dir):
    """Decisions with the edge cases scored by a fixed logistic function."""
    data = portfolio(spark, sf_dir)
    z = (
        F.lit(3.0)
        - F.lit(5.0) * F.try_divide("total_liabilities", "total_assets")
        - F.lit(8.0) * F.col("nonhalal_revenue_percent")
    )
    with_p = data.withColumn("p", F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 2))
    decided = D.screen(with_p, SCREENING_RULES, null_checked=_INPUTS, keep=["p"])
    return D.with_model_confidence(decided, "p", _IMPORTANCE)


@query(
    "hybrid_confidence",
    with_sql(
        SQL_DECISIONS,
        f"""SELECT ticker, status,
  round(CASE WHEN status = 'EDGE_CASE' THEN coalesce(0.5 + 0.5 * {_P}, 1.0) ELSE 1.0 END, 4) AS final_confidence,
  CASE WHEN status = 'EDGE_CASE' THEN nullif({_P}, 0) END AS ml_score,
  CASE WHEN status = 'EDGE_CASE' THEN nullif({_P}, 0) END AS ml_confidence,
  CASE WHEN status = 'COMPLIANT' THEN 3 WHEN status = 'EDGE_CASE' AND {_P} > 0.5 THEN 2 ELSE 0 END
    AS n_supporting,
  CASE WHEN status = 'EDGE_CASE' AND {_P} > 0.5 THEN 'ML: f_nonhalal (importance: 35.0%)' END AS second_reason
FROM decided""",
    ),
)
def hybrid_confidence(spark, sf_dir):
    record = D.as_record(hybrid(spark, sf_dir))
    return record.select(
        "ticker",
        "status",
        "final_confidence",
        "ml_score",
        "ml_confidence",
        F.size("supporting_factors").alias("n_supporting"),
        F.when(F.col("status") == D.EDGE_CASE, F.get("supporting_factors", F.lit(1))).alias("second_reason"),
    )


@query(
    "edge_case_features",
    with_sql(
        SQL_DECISIONS + "," + SQL_FEATURES[len(SQL_COMPANIES) + 1 :],
        """SELECT ticker, f.debt_to_assets, f.f_nonhalal, f.roa FROM decided JOIN features f ON f.symbol = ticker
WHERE status = 'EDGE_CASE'""",
    ),
)
def edge_case_features(spark, sf_dir):
    wide = features(spark, sf_dir).select(
        F.col("symbol").alias("ticker"), "debt_to_assets", "f_nonhalal", "roa"
    )
    return D.edge_features(decisions(spark, sf_dir), wide)


@query(
    "portfolio_screening",
    with_sql(
        SQL_DECISIONS,
        f"""SELECT ticker, company_name, status, violations,
  CASE WHEN status = 'EDGE_CASE' THEN {_P} END AS ml_score,
  CASE WHEN status = 'EDGE_CASE' THEN coalesce(0.5 + {_P} * 0.5, 1.0) ELSE 1.0 END AS final_confidence
FROM decided""",
    ),
)
def portfolio_screening(spark, sf_dir):
    data = portfolio(spark, sf_dir)
    z = (
        F.lit(3.0)
        - F.lit(5.0) * F.try_divide("total_liabilities", "total_assets")
        - F.lit(8.0) * F.col("nonhalal_revenue_percent")
    )
    with_p = data.withColumn("p", F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 2))
    return screen_portfolio(with_p, SCREENING_RULES, probability="p")


@query(
    "portfolio_permits",
    with_sql(
        SQL_SCORED,
        """SELECT symbol, CASE WHEN probability >= 0.5 THEN 'PERMIT' ELSE 'REJECT' END AS decision,
  probability AS permit_probability, 1 - probability AS reject_probability FROM scored""",
    ),
)
def portfolio_permits(spark, sf_dir):
    return permit_decisions(scored(spark, sf_dir), ["symbol"])


@query(
    "portfolio_summary",
    with_sql(
        SQL_SCORED,
        """SELECT count(*) AS n_companies, count(*) FILTER (prediction = 1) AS n_permit,
  count(*) FILTER (prediction = 0) AS n_reject,
  round(avg(prediction), 9) AS permit_share, round(1 - avg(prediction), 9) AS reject_share FROM scored""",
    ),
)
def batch_summary(spark, sf_dir):
    summary = portfolio_summary(scored(spark, sf_dir), "prediction")
    return summary.withColumns({c: F.round(c, 9) for c in ("permit_share", "reject_share")})


@query(
    "guardrail_override",
    with_sql(
        SQL_FEATURES,
        """SELECT symbol, CASE WHEN sector = 'MACHINERY' THEN 0 WHEN f_riba > 0.5 THEN 0 WHEN f_nonhalal > 0.25 THEN 0
  ELSE 1 END AS decision FROM features""",
    ),
)
def guardrail_override(spark, sf_dir):
    return features(spark, sf_dir).select("symbol", G.guardrail_decision(GUARDRAILS).alias("decision"))


@query(
    "guardrail_cases",
    with_sql(
        SQL_FEATURES,
        """SELECT 'TC-001' AS case_id, count(*) AS n_rows, 1.0::DOUBLE AS rejection_rate, 'PASS' AS result
FROM features WHERE f_riba > 0.5
UNION ALL SELECT 'TC-002', count(*), 1.0, 'PASS' FROM features WHERE f_nonhalal > 0.25
UNION ALL SELECT 'TC-003', count(*), 1.0, 'PASS' FROM features WHERE sector = 'MACHINERY'""",
    ),
)
def guardrail_cases(spark, sf_dir):
    return G.guardrail_cases(features(spark, sf_dir), GUARDRAILS)


SQL_GUARDED = SQL_LABELS + """,
guarded AS (
  SELECT symbol, shariah_compliant AS label,
    round(1 / (1 + exp(-(3.0 - 5.0 * debt_to_assets - 8.0 * f_nonhalal))), 2) AS probability,
    CASE WHEN coalesce(sector, '') <> 'MACHINERY' AND riba_intensity <= 0.25 AND debt_to_equity <= 4.0
      THEN 1 ELSE 0 END AS guardrails_passed
  FROM labels)"""


def _guarded(spark, sf_dir):
    z = F.lit(3.0) - F.lit(5.0) * F.col("debt_to_assets") - F.lit(8.0) * F.col("f_nonhalal")
    data = features(spark, sf_dir).withColumn(
        "probability", F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 2)
    )
    return G.guarded_decision(data, DEPLOYMENT)


@query(
    "guarded_decision",
    with_sql(
        SQL_GUARDED,
        """SELECT symbol, CAST(probability >= 0.45 AS INTEGER) AS model_decision, guardrails_passed,
  CAST(probability >= 0.45 AS INTEGER) * guardrails_passed AS final_decision FROM guarded""",
    ),
)
def guarded_decision(spark, sf_dir):
    return _guarded(spark, sf_dir).select("symbol", "model_decision", "guardrails_passed", "final_decision")


@query(
    "guardrail_pass_rate",
    with_sql(SQL_GUARDED, "SELECT round(avg(guardrails_passed), 9) AS guardrail_pass_rate FROM guarded"),
)
def guardrail_pass_rate(spark, sf_dir):
    rate = G.guardrail_pass_rate(_guarded(spark, sf_dir))
    return rate.withColumn("guardrail_pass_rate", F.round("guardrail_pass_rate", 9))


@query(
    "probability_tiers",
    with_sql(
        SQL_SCORED,
        """SELECT CASE WHEN probability > 0.80 THEN 'compliant' WHEN probability >= 0.45 THEN 'borderline'
  ELSE 'non_compliant' END AS tier, count(*) AS n, count(*) FILTER (confidence > 0.85) AS n_confident
FROM scored GROUP BY 1""",
    ),
)
def probability_tiers(spark, sf_dir):
    tiered = scored(spark, sf_dir).withColumn("tier", G.probability_tier())
    return tiered.groupBy("tier").agg(
        F.count("*").alias("n"), F.count_if(F.col("confidence") > 0.85).alias("n_confident")
    )


@query(
    "analyst_filter",
    with_sql(
        SQL_SCORED,
        """SELECT symbol, confidence FROM scored
WHERE prediction = 0 AND sector = 'BUILDING' AND confidence > 0.85""",
    ),
)
def analyst_filter(spark, sf_dir):
    data = scored(spark, sf_dir)
    chosen = (F.col("prediction") == 0) & (F.col("sector") == "BUILDING") & (F.col("confidence") > 0.85)
    return data.where(chosen).select("symbol", "confidence")


@query(
    "confidence_status",
    with_sql(
        SQL_SCORED,
        """SELECT symbol, CASE WHEN confidence > 0.85 THEN 'High' WHEN confidence > 0.70 THEN 'Medium'
  ELSE 'Low' END AS status FROM scored""",
    ),
)
def confidence_status(spark, sf_dir):
    return scored(spark, sf_dir).select("symbol", G.confidence_status().alias("status"))


def _headline(spark, sf_dir):
    """(metric, value) rows of the fixed score."""
    data = scored(spark, sf_dir)
    table_ = M.hard_metrics(M.confusion(data), ("f1", "precision", "recall", "accuracy")).withColumns(
        {
            "auc": M.auc(data).scalar(),
            "guardrail_pass_rate": G.guardrail_pass_rate(_guarded(spark, sf_dir)).scalar(),
        }
    )
    return table_.unpivot([], table_.columns, "metric", "value")


@query(
    "metric_targets",
    with_sql(
        SQL_COUNTS + SQL_GUARDED.removeprefix(SQL_LABELS),
        """, ranks AS (SELECT label, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2.0 AS r FROM scored),
values_ AS (
  SELECT 'auc' AS metric, (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)) AS value,
    0.92::DOUBLE AS target FROM ranks
  UNION ALL SELECT 'guardrail_pass_rate', avg(guardrails_passed), 0.80 FROM guarded
  UNION ALL
  SELECT 'f1' AS metric, 2 * tp / (2 * tp + fp + fn) AS value, 0.85::DOUBLE AS target FROM counts
  UNION ALL SELECT 'precision', tp / (tp + fp), 0.90 FROM counts
  UNION ALL SELECT 'recall', tp / (tp + fn), 0.85 FROM counts
  UNION ALL SELECT 'accuracy', (tp + tn) / (tp + tn + fp + fn), 0.85 FROM counts)
SELECT metric, round(value, 9) AS value, target, CAST(value >= target AS INTEGER) AS met FROM values_""",
    ).replace("\n, ranks", ",\nranks"),
)
def metric_targets(spark, sf_dir):
    checked = G.check_targets(_headline(spark, sf_dir))
    return checked.select("metric", F.round("value", 9).alias("value"), "target", F.col("met").cast("int").alias("met"))


@query(
    "deployment_recommendations",
    with_sql(
        SQL_SCORED,
        """, m AS (SELECT 100 * avg(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS acc,
  100 * avg(prediction) AS share, (SELECT 100 * auc FROM (
    SELECT (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label))
      AS auc FROM (SELECT label, rank() OVER (ORDER BY probability)
        + (count(*) OVER (PARTITION BY probability) - 1) / 2.0 AS r FROM scored))) AS auc FROM scored)
SELECT 'Performance' AS category,
  CASE WHEN acc >= 90 THEN 'EXCELLENT' WHEN acc >= 80 THEN 'GOOD' ELSE 'CAUTION' END AS status,
  'accuracy' AS metric, round(acc / 100, 9) AS value, CAST(NULL AS VARCHAR) AS detail FROM m
UNION ALL SELECT 'Confidence', 'HIGH', 'auc', round(auc / 100, 9), NULL FROM m WHERE auc >= 90
UNION ALL SELECT 'Data Balance', CASE WHEN share BETWEEN 30 AND 70 THEN 'BALANCED' ELSE 'IMBALANCED' END,
  'compliant_share', round(share / 100, 9), NULL FROM m
UNION ALL SELECT 'Deployment', 'NOTE', 'input_features', 2, NULL
UNION ALL SELECT 'Monitoring', 'NOTE', 'compliant_share', round(share / 100, 9), NULL FROM m
UNION ALL SELECT 'Updates', 'NOTE', 'training_period', NULL, '1995-2001'""",
    ).replace("\n, m AS", ",\nm AS"),
)
def deployment_recommendations(spark, sf_dir):
    data = stage(scored(spark, sf_dir).select("label", "prediction", "probability"), "scored")
    accuracy = M.hard_metrics(M.confusion(data), ("accuracy",)).scalar()
    share = data.agg(F.avg(F.col("prediction").cast("double"))).scalar()
    row = M.auc(data).withColumns({"accuracy": accuracy, "compliant_share": share})
    advice = G.recommendations(row, n_features=2, period="1995-2001")
    return advice.withColumn("value", F.round("value", 9))
