"""Calendar parts, time buckets and the integer day key."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grain name -> date_trunc unit. Weeks start on Monday.
GRAIN_UNITS = {
    "daily": "day",
    "weekly": "week",
    "monthly": "month",
    "quarterly": "quarter",
    "yearly": "year",
}


def time_bucket(grain: str, day: Column) -> Column:
    """First day of the bucket a date falls in."""
    if grain not in GRAIN_UNITS:
        raise ValueError(f"unknown time grain: {grain}")
    if grain == "daily":
        return day.cast("date")
    return F.trunc(day, GRAIN_UNITS[grain])


def day_key(day: Column) -> Column:
    """yyyymmdd as int."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def key_day(key: Column) -> Column:
    """Date of a yyyymmdd key; no join to the calendar needed."""
    return F.make_date(F.floor(key / 10000).cast("int"), (F.floor(key / 100) % 100).cast("int"), (key % 100).cast("int"))


def literal_day_key(day: dt.date) -> int:
    return day.year * 10000 + day.month * 100 + day.day


def calendar_parts(day: Column) -> dict[str, Column]:
    """The attributes of a calendar row."""
    return {
        "year": F.year(day).cast("smallint"),
        "quarter": F.quarter(day).cast("smallint"),
        "month": F.month(day).cast("smallint"),
        "month_number": F.month(day).cast("smallint"),
        "month_name": F.date_format(day, "MMMM"),
        "week": F.weekofyear(day).cast("smallint"),
        "day": F.dayofmonth(day).cast("smallint"),
        "day_name": F.date_format(day, "EEEE"),
        "is_weekend": F.weekday(day) >= 5,
    }
