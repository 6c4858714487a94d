"""Results kept beside the facts, by month: states of distinct counts, and the daily summary.

A load tells which months of a fact it rewrote (``load_facts``). Refreshing reads those months of the facts only
and replaces those months of the kept results, late corrections included; without months all are made anew.
"""

from __future__ import annotations

import calendar as months_of_year
import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.calendar import key_day, literal_day_key, time_bucket
from tallyspark.operators.distinct import BITS, BUCKET, bitmaps, distinct_by_bitmap
from tallyspark.operators.upsert import keyed_rows
from tallyspark.plans.metric_query import PERIOD
from tallyspark.plans.timeranges import TimeRange, resolve
from tallyspark.plans.views import SUMMARY, compose_view
from tallyspark.plans.warehouse_jobs import StoredTables
from tallyspark.sources.tables import MONTH, TableStore

DAY = "date_key"


@dataclass(frozen=True)
class DistinctCount:
    """A metric that counts the values of a column, and the dense key that stands for one.

    Where the fact has one row per value its own surrogate key serves; otherwise values are numbered in a table.
    """

    fact: str
    column: str
    key: str
    numbered: bool = False


DISTINCT_COUNTS = {
    "number_of_orders": DistinctCount("fact_orders", "order_id", "order_key"),
    "total_returns": DistinctCount("fact_returns", "return_id", "return_key"),
    "purchase_transactions": DistinctCount("fact_purchases", "purchase_id", "purchase_number", numbered=True),
}


def states_of(metric: str, fact: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """Day, bucket and bitmap of a metric's values; ``numbers`` has the key of each value where the fact has none."""
    count = DISTINCT_COUNTS[metric]
    rows = fact if numbers is None else fact.select(DAY, count.column).distinct().join(numbers, count.column)
    return bitmaps(rows, count.key, [DAY])


def refresh_distinct(store: TableStore, months: Mapping[str, Iterable[int]] | None = None) -> None:
    """Bring the states of all distinct counts up to date with the facts, or with some months of each fact."""
    for metric, count in DISTINCT_COUNTS.items():
        touched = None if months is None else sorted(months.get(count.fact, ()))
        fact = store.read("core", count.fact)
        if fact is None or touched == []:
            continue
        if touched is not None:
            fact = fact.where(F.col(MONTH).isin(touched))
        numbers = None
        if count.numbered:
            with store.sides():
                known = store.read("core", f"number_{count.column}")
                values = store.aside(fact.select(count.column).where(F.col(count.column).isNotNull()).distinct(), "core", f"number_{count.column}__load")
                fresh = keyed_rows(known, values, [count.column], count.key)
                if known is not None:
                    fresh = known.join(values, count.column, "left_anti").unionByName(fresh)
                store.replace(fresh, "core", f"number_{count.column}")
            numbers = store.read("core", f"number_{count.column}")
        states = states_of(metric, fact, numbers).withColumn(MONTH, F.floor(F.col(DAY) / 100).cast("int"))
        store.replace_months(states, "analytics", f"distinct_{metric}", touched)


def count_distinct(
    states: DataFrame, metric: str, time_range: TimeRange | str | None = None, grain: str | None = None, today: dt.date | None = None
) -> DataFrame:
    """The metric over a range of days, by period if a grain is given, from daily states alone."""
    start, end = resolve(time_range, today)
    for bound, low in ((start, True), (end, False)):
        if bound is not None:
            key = literal_day_key(bound)
            states = states.where(F.col(DAY) >= key if low else F.col(DAY) <= key)
            if MONTH in states.columns:
                states = states.where(F.col(MONTH) >= key // 100 if low else F.col(MONTH) <= key // 100)
    by = []
    if grain:
        states, by = states.select(time_bucket(grain, key_day(F.col(DAY))).alias(PERIOD), BUCKET, BITS), [PERIOD]
    return distinct_by_bitmap(states, by, metric)


def stored_count(store: TableStore, metric: str, time_range: TimeRange | str | None = None, grain: str | None = None) -> DataFrame:
    """``count_distinct`` of the states in the store."""
    states = store.read("analytics", f"distinct_{metric}")
    if states is None:
        raise KeyError(f"no states of {metric}: refresh_distinct makes them")
    return count_distinct(states, metric, time_range, grain)


def month_runs(months: Sequence[int]) -> list[tuple[dt.date, dt.date]]:
    """First and last day of each run of consecutive months (yyyymm)."""
    runs: list[list[int]] = []
    for month in sorted(set(months)):
        after = runs and (runs[-1][1] + 1 if runs[-1][1] % 100 < 12 else runs[-1][1] + 89)
        if after == month:
            runs[-1][1] = month
        else:
            runs.append([month, month])
    last = lambda m: dt.date(m // 100, m % 100, months_of_year.monthrange(m // 100, m % 100)[1])
    return [(dt.date(a // 100, a % 100, 1), last(b)) for a, b in runs]


def refresh_summary(store: TableStore, months: Mapping[str, Iterable[int]] | None = None) -> None:
    """Bring the stored daily summary up to date, reading only the months of the facts that a load rewrote.

    A day of the summary depends on the facts of that day alone, so months can be made anew one by one. Days the
    calendar gained need a refresh without months.
    """
    tables = StoredTables(store)
    if months is None:
        parts, touched = [compose_view(tables, SUMMARY)], None
    else:
        touched = sorted({m for own in months.values() for m in own})
        parts = [compose_view(tables, SUMMARY, None, *run) for run in month_runs(touched)]
    if not parts:
        return
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    day = F.col("business_date")
    rows = rows.withColumn(MONTH, (F.year(day) * 100 + F.month(day)).cast("int"))
    store.replace_months(rows, "analytics", "daily_business_summary", touched)
