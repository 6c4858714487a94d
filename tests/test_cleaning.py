import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import calendar as cal
from tallyspark.functions import cleaning as cl
from tallyspark.functions.measures import safe_ratio

SCRIPT = "Sat Aug 15 2026 00:00:00 GMT+0600 (Bangladesh Standard Time)"


def parsed(spark, parse, *cells):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, cell string")
    out = df.select("i", parse("cell").alias("v"), cl.unreadable("cell", parse("cell")).alias("bad")).orderBy("i").collect()
    return [r.v for r in out], [r.bad for r in out]


def test_text_is_trimmed_and_empty_is_null(spark):
    values, _ = parsed(spark, cl.clean_text, "  a ", "", "  ", "\t b\n", " c　", None)
    assert values == ["a", None, None, "b", "c", None]


@pytest.mark.parametrize(
    "parse, expected",
    [
        (cl.parse_date_day_first, [dt.date(2026, 4, 3), None, None, dt.date(2026, 8, 15), dt.date(2026, 8, 15), None, dt.date(2026, 8, 5)]),
        (
            cl.parse_date_month_first,
            [dt.date(2026, 3, 4), dt.date(2026, 8, 15), dt.date(2026, 8, 15), dt.date(2026, 8, 15), None, None, dt.date(2026, 8, 5)],
        ),
    ],
)
def test_dates(spark, parse, expected):
    cells = ["03/04/2026", "2026/08/15", "15-08-2026", SCRIPT, "2026-08-15 10:00:00", "junk", "2026-8-5"]
    values, bad = parsed(spark, parse, *cells)
    assert values == expected
    assert bad == [v is None for v in expected]


def test_impossible_dates_are_unreadable(spark):
    values, bad = parsed(spark, cl.parse_date_day_first, "2026-02-30", "31/31/2026", "13/12/2026", "12/13/2026", "Sat Abc 15 2026 00:00:00 GMT+0600")
    assert values == [None, None, dt.date(2026, 12, 13), dt.date(2026, 12, 13), None]
    assert bad == [True, True, False, False, True]


def test_script_text_keeps_its_own_calendar_day_but_is_an_instant_as_timestamp(spark):
    df = spark.createDataFrame([(SCRIPT,)], "cell string")
    row = df.select(
        cl.parse_date_day_first("cell").alias("d"), F.unix_seconds(cl.parse_timestamp_wide("cell")).alias("s")
    ).first()
    assert row.d == dt.date(2026, 8, 15)
    assert dt.datetime.fromtimestamp(row.s, dt.timezone.utc).isoformat() == "2026-08-14T18:00:00+00:00"


def test_timestamps(spark):
    cells = ["2026-08-15 01:02:03", "2026-08-15T01:02:03", "2026-08-15T01:02:03.25", "2026-08-15 01:02", "2026-08-15", "8/15/2026 01:02:03", "8/15/2026", "x"]
    as_text = lambda parse: lambda c: parse(c).cast("string")
    basic, _ = parsed(spark, as_text(cl.parse_timestamp_basic), *cells)
    wide, bad = parsed(spark, as_text(cl.parse_timestamp_wide), *cells)
    full = ["2026-08-15 01:02:03", "2026-08-15 01:02:03", "2026-08-15 01:02:03.25"]
    assert basic == [*full, None, None, None, None, None]
    assert wide == [*full, "2026-08-15 01:02:00", "2026-08-15 00:00:00", "2026-08-15 01:02:03", "2026-08-15 00:00:00", None]
    assert bad[-1]


@pytest.mark.parametrize(
    "parse, expected",
    [
        (cl.parse_decimal, ["1000.00", None, None, None, "2.35", "-2.35", "-3.00", None]),
        (cl.parse_decimal_commas, ["1000.00", "1234.56", None, None, "2.35", "-2.35", "-3.00", None]),
        (cl.parse_decimal_dollars, ["1000.00", "1234.56", "1234.56", None, "2.35", "-2.35", "-3.00", None]),
        (cl.parse_amount, ["1000.00", "1234.56", "1234.56", "-12.50", "2.35", "-2.35", "-3.00", None]),
    ],
)
def test_numbers(spark, parse, expected):
    values, _ = parsed(spark, parse, "1e3", "1,234.56", "$1,234.56", "(12.50)", "2.345", "-2.345", " -3 ", "abc")
    assert values == [Decimal(e) if e else None for e in expected]


def test_quantity_has_three_decimals(spark):
    values, _ = parsed(spark, cl.parse_quantity, "(1,000.1255)", "2")
    assert values == [Decimal("-1000.126"), Decimal("2.000")]


def test_int(spark):
    values, bad = parsed(spark, cl.parse_int, "12", " -3", "1.5", "99999999999", "")
    assert values == [12, -3, None, None, None]
    assert bad == [False, False, True, True, False]


def test_boolean(spark):
    values, bad = parsed(spark, cl.parse_boolean, "Yes", "1", "active", "N", "0", "INACTIVE", " ", "maybe")
    assert values == [True, True, True, False, False, False, None, None]
    assert bad == [False] * 7 + [True]


def test_term(spark):
    values, _ = parsed(spark, cl.normalize_term, "  Gross__Sales ", "TOTAL   orders")
    assert values == ["gross sales", "total orders"]


def test_calendar_parts_and_keys(spark):
    df = spark.createDataFrame([(dt.date(2026, 8, 16),), (dt.date(2027, 1, 1),)], "d date")
    parts = df.select(*[c.alias(n) for n, c in cal.calendar_parts(F.col("d")).items()], cal.day_key(F.col("d")).alias("k")).collect()
    assert parts[0].asDict() == {
        "year": 2026, "quarter": 3, "month": 8, "month_number": 8, "month_name": "August", "week": 33, "day": 16,
        "day_name": "Sunday", "is_weekend": True, "k": 20260816,
    }
    assert parts[1].week == 53
    back = df.select(cal.key_day(cal.day_key(F.col("d"))).alias("d")).collect()
    assert [r.d for r in back] == [dt.date(2026, 8, 16), dt.date(2027, 1, 1)]
    starts = {g: df.select(cal.time_bucket(g, F.col("d")).alias("b")).first().b for g in cal.GRAIN_UNITS}
    assert starts == {
        "daily": dt.date(2026, 8, 16), "weekly": dt.date(2026, 8, 10), "monthly": dt.date(2026, 8, 1),
        "quarterly": dt.date(2026, 7, 1), "yearly": dt.date(2026, 1, 1),
    }
    with pytest.raises(ValueError):
        cal.time_bucket("hourly", F.col("d"))


def test_division_by_zero_is_null(spark):
    assert spark.range(1).select(safe_ratio(F.lit(1), F.lit(0)).alias("r")).first().r is None
