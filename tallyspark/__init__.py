"""Retail warehouse and metrics engine expressed as Spark DataFrame plans."""

from tallyspark.session import build_session

__all__ = ["build_session"]
