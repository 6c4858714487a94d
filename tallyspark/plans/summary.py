"""One row per calendar day over all facts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.plans import views

Tables = Mapping[str, DataFrame]

AMOUNT = "decimal(38,2)"
AMOUNT_3 = "decimal(38,3)"
COUNT = "bigint"


def _sum(column: str, when: Column | None = None) -> Column:
    value = F.col(column) if when is None else F.when(when, F.col(column))
    return F.sum(value)


def _rows(when: Column | None = None) -> Column:
    return F.count("*") if when is None else F.count_if(when)


def _is(column: str, *values: str) -> Column:
    return F.col(column).isin(*values)


def _measures(capital_in: Sequence[str]) -> dict[str, dict[str, tuple[Column, str]]]:
    """fact -> measure -> (aggregate, type). Both kinds of return share one scan, as do both cash directions."""
    customer, supplier = _is("return_type", "CUSTOMER_RETURN"), _is("return_type", "SUPPLIER_RETURN")
    return {
        "fact_orders": {
            "total_orders": (_rows(), COUNT),
            "total_order_amount": (_sum("total_amount"), AMOUNT),
        },
        "fact_sales": {
            "total_sales_amount": (_sum("line_total"), AMOUNT),
            "total_sales_quantity": (_sum("quantity"), AMOUNT_3),
        },
        "fact_payments": {"total_payments": (_sum("amount"), AMOUNT)},
        "fact_returns": {
            "total_customer_returns": (_rows(customer), COUNT),
            "total_customer_return_amount": (_sum("refund_amount", customer), AMOUNT),
            "total_customer_cash_refund": (_sum("cash_refund", customer), AMOUNT),
            "total_customer_due_adjustment": (_sum("due_adjustment", customer), AMOUNT),
            "total_supplier_returns": (_rows(supplier), COUNT),
            "total_supplier_return_amount": (_sum("refund_amount", supplier), AMOUNT),
        },
        "fact_purchases": {
            "total_purchases": (F.count_distinct("purchase_id"), COUNT),
            "total_purchase_amount": (_sum("line_total"), AMOUNT),
            "total_purchase_quantity": (_sum("quantity"), AMOUNT_3),
        },
        "fact_expenses": {"total_expenses": (_sum("amount"), AMOUNT)},
        "fact_partner_capital": {
            "capital_added": (_sum("amount", _is("transaction_type", *capital_in)), AMOUNT),
            "capital_withdrawn": (_sum("amount", _is("transaction_type", "WITHDRAWAL")), AMOUNT),
        },
        "fact_cash_transactions": {
            "total_cash_in": (_sum("amount", _is("direction", "IN")), AMOUNT),
            "total_cash_out": (_sum("amount", _is("direction", "OUT")), AMOUNT),
        },
    }


# result -> measures it is made of, first minus the rest
DIFFERENCES = {
    "net_sales": ("total_sales_amount", "total_customer_return_amount"),
    "gross_business_margin": ("total_sales_amount", "total_customer_return_amount", "total_purchase_amount"),
    "operating_result": (
        "total_sales_amount", "total_customer_return_amount", "total_purchase_amount", "total_expenses",
    ),
}
CALENDAR = ("year", "quarter", "month", "month_name", "week", "day", "day_name", "is_weekend")


def _per_day(
    tables: Tables,
    days: DataFrame,
    measures: Mapping[str, Mapping[str, tuple[Column, str]]],
    differences: Mapping[str, Sequence[str]],
    columns: Sequence[str] | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Calendar days with the measures of all facts, zero where a day has none.

    Each fact is cut to one row per day first; the day rows are stacked and
    added up once, instead of joining ten aggregates to the calendar. Facts
    that no asked-for column needs are not read.
    """
    needed = None if columns is None else set(columns)
    if needed is not None:
        for name in needed & set(differences):
            needed = needed | set(differences[name])
    types: dict[str, str] = {}
    daily = []
    for fact, wanted in measures.items():
        chosen = {n: parts for n, parts in wanted.items() if needed is None or n in needed}
        types.update({n: kind for n, (_, kind) in chosen.items()})
        if chosen:
            rows = views.limit_days(tables[fact], start, end)
            daily.append(rows.groupBy("date_key").agg(*[a.cast(kind).alias(n) for n, (a, kind) in chosen.items()]))
    result = views.limit_days(days, start, end)
    own = result.columns
    if daily:
        stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), daily)
        added = stacked.groupBy("date_key").agg(*[F.sum(n).alias(n) for n in types])
        result = result.join(added, "date_key", "left")
    result = result.select(*own, *[F.coalesce(F.col(n), F.lit(0)).cast(t).alias(n) for n, t in types.items()])
    for name, (first, *rest) in differences.items():
        if needed is None or name in needed:
            result = result.withColumn(name, reduce(lambda a, c: a - F.col(c), rest, F.col(first)).cast(AMOUNT))
    return result


def daily_business_summary(
    tables: Tables,
    start: dt.date | None = None,
    end: dt.date | None = None,
    columns: Sequence[str] | None = None,
    capital_in: Sequence[str] = ("CAPITAL",),
) -> DataFrame:
    """Every calendar day with counts and totals of all facts."""
    days = tables["dim_date"].select("date_key", F.col("date").alias("business_date"), *CALENDAR)
    return _per_day(tables, days, _measures(capital_in), DIFFERENCES, columns, start, end)


def small_daily_summary(tables: Tables) -> DataFrame:
    """The earlier, smaller summary: order totals as sales, all returns together, no expenses, capital or cash."""
    measures = {
        "fact_orders": {"total_orders": (_rows(), COUNT), "total_sales": (_sum("total_amount"), AMOUNT)},
        "fact_payments": {"total_payments": (_sum("amount"), AMOUNT)},
        "fact_returns": {
            "total_returns": (_rows(), COUNT),
            "total_return_amount": (_sum("refund_amount"), AMOUNT),
            "total_cash_refund": (_sum("cash_refund"), AMOUNT),
            "total_due_adjustment": (_sum("due_adjustment"), AMOUNT),
        },
        "fact_purchases": {
            "total_purchases": (F.count_distinct("purchase_id"), COUNT),
            "total_purchase_amount": (_sum("line_total"), AMOUNT),
        },
    }
    differences = {
        "net_sales": ("total_sales", "total_return_amount"),
        "gross_business_margin": ("total_sales", "total_return_amount", "total_purchase_amount"),
    }
    days = tables["dim_date"].select("date_key", F.col("date").alias("business_date"))
    return _per_day(tables, days, measures, differences)
