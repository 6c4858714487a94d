import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.plans.timeranges import PRESETS, TimeRange, UnknownTimeRange, preset_bounds, preset_columns, resolve
from tests.conftest import day

CASES = [
    ("today", "2026-08-19", "2026-08-19", "2026-08-19"), ("yesterday", "2026-01-01", "2025-12-31", "2025-12-31"),
    ("current_week", "2026-08-19", "2026-08-17", "2026-08-23"), ("current_week", "2026-08-17", "2026-08-17", "2026-08-23"),
    ("current_week", "2026-08-23", "2026-08-17", "2026-08-23"), ("last_week", "2026-08-19", "2026-08-10", "2026-08-16"),
    ("current_month", "2028-02-10", "2028-02-01", "2028-02-29"), ("last_month", "2026-01-15", "2025-12-01", "2025-12-31"),
    ("current_quarter", "2026-08-19", "2026-07-01", "2026-09-30"), ("last_quarter", "2026-02-01", "2025-10-01", "2025-12-31"),
    ("current_year", "2026-08-19", "2026-01-01", "2026-12-31"), ("last_year", "2026-08-19", "2025-01-01", "2025-12-31"),
    ("last_7_days", "2026-08-19", "2026-08-13", "2026-08-19"), ("last_30_days", "2026-08-19", "2026-07-21", "2026-08-19"),
    ("last_90_days", "2026-08-19", "2026-05-22", "2026-08-19"), ("year_to_date", "2026-08-19", "2026-01-01", "2026-08-19"),
    ("month_to_date", "2026-08-19", "2026-08-01", "2026-08-19"),
]


@pytest.mark.parametrize("preset, today, start, end", CASES)
def test_presets(preset, today, start, end):
    assert preset_bounds(preset, day(today)) == (day(start), day(end))


def test_all_time_and_coverage():
    assert preset_bounds("all_time", day("2026-08-19")) == (None, None)
    assert {c[0] for c in CASES} | {"all_time"} == set(PRESETS)


def test_column_form_equals_driver_form(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=13 * i) for i in range(60)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for preset in PRESETS:
        low, high = preset_columns(preset, F.col("d"))
        got = df.select("d", low.cast("date").alias("a"), high.cast("date").alias("b")).collect()
        assert all((r.a, r.b) == preset_bounds(preset, r.d) for r in got), preset


def test_resolve():
    assert resolve(None) == (None, None)
    assert resolve(TimeRange(preset="today", start=day("2026-01-01"))) == (day("2026-01-01"), None)
    with pytest.raises(UnknownTimeRange):
        resolve(TimeRange(label="since the fair"))
    with pytest.raises(UnknownTimeRange):
        resolve("fortnight", day("2026-01-01"))
    with pytest.raises(ValueError):
        TimeRange()
    with pytest.raises(ValueError):
        TimeRange(start=day("2026-01-02"), end=day("2026-01-01"))
