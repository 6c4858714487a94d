"""Guarded arithmetic and defaults used by fact loads and views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.cleaning import MONEY


def or_zero(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


def or_word(c: Column | str, word: str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(word))


def money(c: Column) -> Column:
    return c.cast(MONEY)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Division that yields NULL for a zero or NULL divisor (also in ANSI mode)."""
    return top / F.nullif(bottom, F.lit(0))


def gross_line(quantity: Column, price: Column) -> Column:
    return money(quantity * price)


def net_line(quantity: Column, price: Column, discount: Column) -> Column:
    return money(quantity * price - discount)
