"""Imports every module that registers queries."""

from tallyspark.registered import metric_queries, report_queries, text_queries, warehouse_queries  # noqa: F401
from tallyspark.registered.base import REGISTRY

__all__ = ["REGISTRY"]
