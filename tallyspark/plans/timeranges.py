"""Relative time ranges resolved to a first and a last day, both included."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names a request may use.
PRESETS = (
    "today", "yesterday", "current_week", "last_week", "current_month", "last_month", "current_quarter",
    "last_quarter", "current_year", "last_year", "last_7_days", "last_30_days", "last_90_days", "year_to_date",
    "month_to_date", "all_time",
)

_SPANS = {"week": None, "month": 1, "quarter": 3, "year": 12}


class UnknownTimeRange(ValueError):
    """A preset or label nobody can turn into dates."""


@dataclass(frozen=True)
class TimeRange:
    preset: str | None = None
    start: dt.date | None = None
    end: dt.date | None = None
    label: str | None = None

    def __post_init__(self):
        if self.preset is None and self.label is None and self.start is None and self.end is None:
            raise ValueError("a time range needs a preset, a label or a date")
        if self.start and self.end and self.start > self.end:
            raise ValueError("start cannot be later than end")


def _months_on(day: dt.date, months: int) -> dt.date:
    index = day.year * 12 + day.month - 1 + months
    return dt.date(index // 12, index % 12 + 1, 1)


def _span_start(day: dt.date, unit: str) -> dt.date:
    if unit == "week":
        return day - dt.timedelta(days=day.weekday())
    months = _SPANS[unit]
    return dt.date(day.year, (day.month - 1) // months * months + 1, 1)


def _shift(start: dt.date, unit: str, steps: int) -> dt.date:
    return start + dt.timedelta(days=7 * steps) if unit == "week" else _months_on(start, _SPANS[unit] * steps)


def preset_bounds(preset: str, today: dt.date) -> tuple[dt.date | None, dt.date | None]:
    """First and last day of a preset, seen from ``today``."""
    one_day = dt.timedelta(days=1)
    if preset not in PRESETS:
        raise UnknownTimeRange(f"unknown time range: {preset}")
    if preset == "all_time":
        return None, None
    if preset in ("today", "yesterday"):
        day = today - one_day * (preset == "yesterday")
        return day, day
    if preset.endswith("_to_date"):
        return _span_start(today, preset.split("_")[0]), today
    which, middle, *rest = preset.split("_")
    if rest:  # last_<n>_days
        return today - one_day * (int(middle) - 1), today
    start = _shift(_span_start(today, middle), middle, -1 if which == "last" else 0)
    return start, _shift(start, middle, 1) - one_day


def resolve(time_range: TimeRange | str | None, today: dt.date | None = None) -> tuple[dt.date | None, dt.date | None]:
    """Days a request covers; explicit dates win over a preset, a bare label cannot be resolved."""
    if time_range is None:
        return None, None
    if isinstance(time_range, str):
        time_range = TimeRange(preset=time_range)
    if time_range.start or time_range.end:
        return time_range.start, time_range.end
    if time_range.preset is None:
        raise UnknownTimeRange(f"label {time_range.label!r} is not a known time range")
    return preset_bounds(time_range.preset, today or dt.date.today())


def preset_columns(preset: str, today: Column) -> tuple[Column, Column]:
    """The same bounds when ``today`` is a column (one anchor day per row)."""
    none = F.lit(None).cast("date")
    if preset not in PRESETS:
        raise UnknownTimeRange(f"unknown time range: {preset}")
    if preset == "all_time":
        return none, none
    if preset in ("today", "yesterday"):
        day = F.date_sub(today, 1 if preset == "yesterday" else 0)
        return day, day
    if preset.endswith("_to_date"):
        return F.trunc(today, preset.split("_")[0]), today
    which, middle, *rest = preset.split("_")
    if rest:
        return F.date_sub(today, int(middle) - 1), today
    steps = -1 if which == "last" else 0
    start = F.trunc(today, middle)
    if middle == "week":
        start = F.date_add(start, 7 * steps)
        return start, F.date_add(start, 6)
    start = F.add_months(start, _SPANS[middle] * steps)
    return start, F.date_sub(F.add_months(start, _SPANS[middle]), 1)
