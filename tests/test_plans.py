"""What the physical plans must and must not contain."""

import pytest

from sieveline.catalog import QUERIES
from sieveline.catalog.base import companies, features
from sieveline.operators.ranking import running_counts
from sieveline.operators.screening import screen

PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups")
ROWWISE = [
    "feature_table",
    "compliance_labels",
    "decision_table",
    "decision_rule_trace",
    "hybrid_confidence",
    "guarded_decision",
    "interaction_features",
    "confusion_matrix",
    "threshold_search",
]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ROWWISE)
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert not any(p in plan for p in PYTHON)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_screening_adds_no_shuffle(spark, sf_dir):
    base = companies(spark, sf_dir).withColumnRenamed("symbol", "ticker")
    assert plan_of(screen(base)).count("Exchange") == plan_of(base).count("Exchange")


def test_features_add_no_shuffle(spark, sf_dir):
    assert plan_of(features(spark, sf_dir)).count("Exchange") == plan_of(companies(spark, sf_dir)).count("Exchange")


def test_scans_are_pruned(spark, sf_dir):
    plan = plan_of(QUERIES["sector_value_counts"](spark, sf_dir).select("sector"))
    assert "c_acctbal" not in plan and "c_name" not in plan


def test_windows_see_partitions_not_tables(spark):
    """The only window without keys runs on one row per partition."""
    df = spark.range(1000).selectExpr("id % 97 AS v")
    ranked = running_counts(df, "v")
    plan = plan_of(ranked)
    assert plan.count("SinglePartition") == 1
    assert "HashAggregate" in plan.split("SinglePartition", 1)[1]
