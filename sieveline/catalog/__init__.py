"""Registered queries over the test tables, with their SQL twins."""

from sieveline.catalog import feature_queries, ingest, metric_queries, model_queries, rule_queries  # noqa: F401
from sieveline.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
