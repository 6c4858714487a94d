"""Metric requests: every metric, grain, filter, preset and combination."""

from __future__ import annotations

import datetime as dt
from collections import ChainMap
from dataclasses import replace

from pyspark.sql import functions as F

from tallyspark.functions.calendar import GRAIN_UNITS
from tallyspark.operators.combine import combine_results
from tallyspark.plans.metric_query import Filter, MetricRequest, Sort, compare_periods, metric_query
from tallyspark.plans.metrics import Metric, standard_registry
from tallyspark.plans.timeranges import PRESETS, TimeRange, preset_bounds, preset_columns
from tallyspark.plans.tpch_warehouse import TpchWarehouse
from tallyspark.plans.views import VIEWS
from tallyspark.registered.base import on_warehouse, register, table
from tallyspark.registered.ctes import with_ctes

TODAY = dt.date(1998, 1, 20)

# metric -> aggregate over its view; money as double, counts as they are
AGGREGATE = {
    "number_of_orders": "count(DISTINCT order_id)",
    "total_returns": "count(DISTINCT return_id)",
    "purchase_transactions": "count(DISTINCT purchase_id)",
    "gross_sales": "sum(gross_sales)",
    "net_sales": "sum(net_sales)",
    "gross_business_margin": "sum(gross_business_margin)",
    "total_payments": "sum(amount)",
    "return_amount": "sum(refund_amount)",
    "cash_refund": "sum(cash_refund)",
    "due_adjustment": "sum(due_adjustment)",
    "total_purchases": "sum(line_total)",
    "cash_in": "sum(amount) FILTER (direction = 'IN')",
    "cash_out": "sum(amount) FILTER (direction = 'OUT')",
    "total_expenses": "sum(amount)",
    "capital_invested": "sum(amount) FILTER (transaction_type = 'CAPITAL')",
    "capital_withdrawn": "sum(amount) FILTER (transaction_type = 'WITHDRAWAL')",
    "stock_in_quantity": "sum(quantity) FILTER (direction = 'IN')",
    "stock_out_quantity": "sum(quantity) FILTER (direction = 'OUT')",
}
MATCHES = {
    "cash_in": "direction = 'IN'", "cash_out": "direction = 'OUT'", "capital_invested": "transaction_type = 'CAPITAL'",
    "capital_withdrawn": "transaction_type = 'WITHDRAWAL'", "stock_in_quantity": "direction = 'IN'",
    "stock_out_quantity": "direction = 'OUT'",
}


def _date(view: str) -> str:
    return VIEWS[view].date_column if view in VIEWS else "business_date"


def _measure(name: str) -> str:
    value = f"coalesce({AGGREGATE[name]}, 0)"
    return f"{value} AS {name}" if "count" in AGGREGATE[name] else f"CAST({value} AS DOUBLE) AS {name}"


def metric_sql(
    metrics: list[str], view: str, dims: tuple[str, ...] = (), grain: str | None = None, where: str = "TRUE", tail: str = ""
) -> str:
    """The same request as plain SQL over the full view, without CTEs."""
    keys = list(dims)
    select = list(dims)
    if grain:
        bucket = f"CAST(date_trunc('{GRAIN_UNITS[grain]}', {_date(view)}) AS DATE)"
        keys.append(bucket)
        select.append(f"{bucket} AS period")
    matching = [MATCHES.get(m) for m in metrics]
    if all(matching):
        where = f"({where}) AND ({' OR '.join(matching)})"
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    return f"SELECT {', '.join([*select, *map(_measure, metrics)])} FROM {view} WHERE {where}{group}{tail}"


def register_request(name: str, request: MetricRequest, view: str, where: str = "TRUE", tail: str = "") -> None:
    register(
        name,
        on_warehouse(lambda w: metric_query(w, request, today=TODAY)),
        with_ctes(metric_sql(list(request.metrics), view, tuple(request.dimensions), request.time_grain, where, tail)),
    )


# the flagship: fact load, view, date range, month buckets, top five ------------------

register_request(
    "flagship_top_months",
    MetricRequest(
        ["gross_sales"], ["product_category"], time_grain="monthly",
        time_range=TimeRange(start=dt.date(1996, 1, 1), end=dt.date(1999, 12, 31)),
        order_by=[Sort("gross_sales", True), Sort("period"), Sort("product_category")], limit=5,
    ),
    "v_sales", "sale_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'",
    " ORDER BY gross_sales DESC NULLS FIRST, period, product_category LIMIT 5",
)

# every metric by one of its dimensions, per year -------------------------------------

METRIC_VIEW = {
    "number_of_orders": ("v_orders", ("order_status",)), "gross_sales": ("v_sales", ("product_category", "location_name")),
    "net_sales": ("v_daily_business_summary", ()), "total_payments": ("v_payments", ("payment_method",)),
    "total_returns": ("v_returns", ("return_type", "location_name")), "return_amount": ("v_returns", ("status",)),
    "cash_refund": ("v_returns", ("cash_account_name",)), "due_adjustment": ("v_returns", ("return_type",)),
    "total_purchases": ("v_purchases", ("supplier_name",)), "purchase_transactions": ("v_purchases", ("location_name",)),
    "cash_in": ("v_cash_transactions", ("cash_account_name",)), "cash_out": ("v_cash_transactions", ("transaction_type", "created_by")),
    "total_expenses": ("v_expenses", ("expense_category", "paid_by")), "capital_invested": ("v_partner_capital", ("partner_name",)),
    "capital_withdrawn": ("v_partner_capital", ("partner_id", "cash_account_name")),
    "stock_in_quantity": ("v_stock_movements", ("to_location_name", "movement_type")),
    "stock_out_quantity": ("v_stock_movements", ("product_name",)), "gross_business_margin": ("v_daily_business_summary", ()),
}
for _name, (_view, _dims) in METRIC_VIEW.items():
    register_request(f"metric_{_name}", MetricRequest([_name], _dims, time_grain="yearly"), _view)

register_request("metric_total", MetricRequest(["gross_sales"]), "v_sales")
register_request("metric_by_dimension", MetricRequest(["gross_sales"], ["customer_name", "product_category"]), "v_sales")
register_request("metric_by_product", MetricRequest(["gross_sales"], ["product_id", "product_name"], time_grain="quarterly"), "v_sales")
for _grain in GRAIN_UNITS:
    register_request(f"metric_grain_{_grain}", MetricRequest(["number_of_orders"], time_grain=_grain), "v_orders")

# filters -------------------------------------------------------------------------------

FILTERS = {
    "eq": (Filter("product_category", "eq", "PROMO"), "product_category = 'PROMO'"),
    "ne": (Filter("customer_name", "ne", "Customer#000000001"), "customer_name <> 'Customer#000000001'"),
    "gt": (Filter("location_name", "gt", "NATION_2"), "location_name > 'NATION_2'"),
    "gte": (Filter("location_name", "gte", "NATION_2"), "location_name >= 'NATION_2'"),
    "lt": (Filter("product_name", "lt", "medium"), "product_name < 'medium'"),
    "lte": (Filter("location_name", "lte", "NATION_2"), "location_name <= 'NATION_2'"),
    "in": (Filter("product_category", "in", ["PROMO", "SMALL"]), "product_category IN ('PROMO', 'SMALL')"),
    "not_in": (Filter("customer_id", "not_in", ["1", "2", "3"]), "customer_id NOT IN ('1', '2', '3')"),
    "like": (Filter("product_name", "like", "%ring"), "product_name LIKE '%ring'"),
    "ilike": (Filter("product_name", "ilike", "%RING"), "product_name ILIKE '%RING'"),
    "is_null": (Filter("customer_name", "is_null"), "customer_name IS NULL"),
    "is_not_null": (Filter("customer_id", "is_not_null"), "customer_id IS NOT NULL"),
    "between": (Filter("location_name", "between", ["NATION_1", "NATION_3"]), "location_name BETWEEN 'NATION_1' AND 'NATION_3'"),
}
for _op, (_filter, _where) in FILTERS.items():
    register_request(
        f"filter_{_op}", MetricRequest(["gross_sales"], ["product_category"], [_filter]), "v_sales", _where
    )
register_request(
    "filter_several",
    MetricRequest(
        ["gross_sales"], ["customer_name"],
        [Filter("product_category", "eq", "LARGE"), Filter("customer_name", "like", "%7"), Filter("location_name", "ne", "NATION_4")],
    ),
    "v_sales", "product_category = 'LARGE' AND customer_name LIKE '%7' AND location_name <> 'NATION_4'",
)

# time ranges -----------------------------------------------------------------------------

for _preset in PRESETS:
    _start, _end = preset_bounds(_preset, TODAY)
    register_request(
        f"preset_{_preset}",
        MetricRequest(["number_of_orders"], ["order_status"], time_range=_preset),
        "v_orders",
        "TRUE" if _start is None else f"order_date BETWEEN DATE '{_start}' AND DATE '{_end}'",
    )

_UNIT_SQL = {"week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 1 YEAR"}


def _preset_sql(preset: str) -> str:
    """Bounds of a preset from a column d, written with DuckDB's own calendar functions."""
    if preset == "all_time":
        low, high = "CAST(NULL AS DATE)", "CAST(NULL AS DATE)"
    elif preset in ("today", "yesterday"):
        low = high = "d" if preset == "today" else "d - 1"
    elif preset.endswith("_to_date"):
        low, high = f"date_trunc('{preset.split('_')[0]}', d)", "d"
    elif preset.endswith("_days"):
        low, high = f"d - {int(preset.split('_')[1]) - 1}", "d"
    else:
        which, unit = preset.split("_")
        low = f"date_trunc('{unit}', d)" + (f" - {_UNIT_SQL[unit]}" if which == "last" else "")
        high = f"{low} + {_UNIT_SQL[unit]} - INTERVAL 1 DAY"
    return f"SELECT d AS anchor, '{preset}' AS preset, CAST({low} AS DATE) AS first_day, CAST({high} AS DATE) AS last_day FROM days"


def _all_presets(spark, folder):
    days = table("orders")(spark, folder).select(F.col("o_orderdate").cast("date").alias("anchor")).distinct()
    bounds = [
        F.struct(F.lit(p).alias("preset"), low.cast("date").alias("first_day"), high.cast("date").alias("last_day"))
        for p in PRESETS
        for low, high in [preset_columns(p, F.col("anchor"))]
    ]
    return days.select("anchor", F.inline(F.array(*bounds)))


register(
    "preset_columns",
    _all_presets,
    "WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) " + " UNION ALL ".join(map(_preset_sql, PRESETS)),
)
register_request(
    "date_range_explicit",
    MetricRequest(["gross_sales"], ["location_id"], time_range=TimeRange(start=dt.date(1997, 3, 5), end=dt.date(1997, 9, 1)),
                  time_grain="weekly"),
    "v_sales", "sale_date BETWEEN DATE '1997-03-05' AND DATE '1997-09-01'",
)

# sorting and cutting -------------------------------------------------------------------

register_request(
    "topn",
    MetricRequest(["gross_sales"], ["product_id"], order_by=[Sort("gross_sales", True), Sort("product_id")], limit=10),
    "v_sales", "TRUE", " ORDER BY gross_sales DESC NULLS FIRST, product_id ASC NULLS LAST LIMIT 10",
)
register_request(
    "sort_nulls",
    # the group without a customer comes first when descending
    MetricRequest(["gross_sales"], ["customer_name"], order_by=[Sort("customer_name", True)], limit=3),
    "v_sales", "TRUE", " ORDER BY customer_name DESC NULLS FIRST LIMIT 3",
)
register_request(
    "row_cap",
    MetricRequest(["number_of_orders"], ["customer_id"], order_by=[Sort("customer_id")], limit=500, row_cap=100),
    "v_orders", "TRUE", " ORDER BY customer_id ASC NULLS LAST LIMIT 100",
)

# several metrics ------------------------------------------------------------------------

register_request("cond_agg_cash", MetricRequest(["cash_in", "cash_out"], ["cash_account_name"]), "v_cash_transactions")
register_request(
    "one_view_four_metrics",
    MetricRequest(["total_returns", "return_amount", "cash_refund", "due_adjustment"], ["return_type"], time_grain="monthly"),
    "v_returns",
)
register_request("merge_split", MetricRequest(["cash_in", "cash_out"], time_grain="daily"), "v_cash_transactions")
register_request("capital_flows", MetricRequest(["capital_invested", "capital_withdrawn"], ["partner_name"]), "v_partner_capital")


def _merged_sql(parts: list[tuple[str, str, str]], dims: tuple[str, ...], grain: str | None) -> str:
    keys = [*dims, *(["period"] if grain else [])]
    subs = ", ".join(f"q{i} AS ({metric_sql([m], v, dims, grain)})" for i, (m, v, _) in enumerate(parts))
    names = [m for m, _, _ in parts]
    every = " UNION ".join(f"SELECT {', '.join(keys)} FROM q{i}" for i in range(len(parts)))
    joins = " ".join(
        f"LEFT JOIN q{i} ON " + " AND ".join(f"k.{c} IS NOT DISTINCT FROM q{i}.{c}" for c in keys) for i in range(len(parts))
    )
    select = [f"k.{c}" for c in keys] + [f"coalesce(q{i}.{m}, 0) AS {m}" for i, m in enumerate(names)]
    return f", {subs}, k AS ({every}) SELECT {', '.join(select)} FROM k {joins}"


def register_merge(name: str, metrics: list[str], dims: tuple[str, ...] = (), grain: str | None = None, compare: bool = False) -> None:
    parts = [(m, METRIC_VIEW[m][0], m) for m in metrics]
    register(
        name,
        on_warehouse(lambda w: metric_query(w, MetricRequest(metrics, dims, time_grain=grain, compare=compare))),
        with_ctes(_merged_sql(parts, dims, grain)),
    )


register_merge("merge_compare", ["gross_sales", "total_expenses"], (), "monthly", compare=True)
register_merge("merge_null_keys", ["gross_sales", "number_of_orders", "total_payments"], ("customer_name",))
register_merge("merge_side_by_side", ["total_payments", "total_expenses", "cash_in"], ("cash_account_id",), "weekly")
register_merge("merge_with_summary", ["net_sales", "total_expenses", "gross_business_margin"], (), "yearly")
register(
    "merge_side_by_side_scalar",
    on_warehouse(lambda w: metric_query(w, MetricRequest(["gross_sales", "total_expenses", "number_of_orders"]))),
    with_ctes(
        "SELECT CAST((SELECT sum(gross_sales) FROM v_sales) AS DOUBLE) AS gross_sales,"
        " CAST((SELECT sum(amount) FROM v_expenses) AS DOUBLE) AS total_expenses,"
        " (SELECT count(DISTINCT order_id) FROM v_orders) AS number_of_orders"
    ),
)
register(
    "merge_sorted_cut",
    on_warehouse(
        lambda w: metric_query(
            w,
            MetricRequest(["cash_in", "total_expenses"], ["cash_account_name"],
                          order_by=[Sort("total_expenses", True), Sort("cash_account_name")], limit=7),
        )
    ),
    with_ctes(
        _merged_sql([("cash_in", "v_cash_transactions", ""), ("total_expenses", "v_expenses", "")], ("cash_account_name",), None)
        + " ORDER BY total_expenses DESC NULLS FIRST, k.cash_account_name ASC NULLS LAST LIMIT 7"
    ),
)


def _null_or_missing(spark, folder):
    """Measures that are NULL for a present key stay NULL; keys a result lacks count 0; NULL is one key."""
    events = table("events")(spark, folder)
    key = F.when(F.col("user_id") % 9 != 0, F.col("user_id") % 50).alias("k")
    clicks = events.where("event_type = 'click' and user_id % 50 < 30").groupBy(key).agg(
        F.sum(F.when(F.col("user_id") % 50 != 4, F.col("value").cast("decimal(14,2)"))).alias("clicked")
    )
    errors = events.where("event_type = 'error' and user_id % 50 > 20").groupBy(key).agg(F.count("*").alias("errors"))
    return combine_results([(clicks, ["clicked"]), (errors, ["errors"])], ["k"])


register(
    "merge_null_vs_missing",
    _null_or_missing,
    """WITH e AS (SELECT *, CASE WHEN user_id % 9 <> 0 THEN user_id % 50 END AS k FROM events),
c AS (SELECT k, sum(CASE WHEN user_id % 50 <> 4 THEN CAST(value AS DECIMAL(14,2)) END) AS clicked, TRUE AS has FROM e
  WHERE event_type = 'click' AND user_id % 50 < 30 GROUP BY k),
r AS (SELECT k, count(*) AS errors FROM e WHERE event_type = 'error' AND user_id % 50 > 20 GROUP BY k),
keys AS (SELECT k FROM c UNION SELECT k FROM r)
SELECT keys.k, CAST(CASE WHEN c.has THEN clicked ELSE 0 END AS DOUBLE) AS clicked, coalesce(errors, 0) AS errors
FROM keys LEFT JOIN c ON keys.k IS NOT DISTINCT FROM c.k LEFT JOIN r ON keys.k IS NOT DISTINCT FROM r.k""",
)

# user-defined metrics: the declared kinds no standard metric uses -----------------------


def _own_registry():
    registry = standard_registry(capital_in=("CAPITAL", "INVESTMENT"))
    registry.add(Metric("order_rows", "v_orders", "count", None, ("order_status",)))
    registry.add(Metric("orders_with_customer", "v_orders", "count", "customer_id", ("order_status",)))
    registry.add(Metric("order_value", "v_orders", "sum", "total_amount", ("order_status",)))
    registry.add(Metric("average_order", "v_orders", "average", "total_amount", ("order_status",), zero_if_no_data=False))
    registry.add(
        Metric("value_per_order", "v_orders", "ratio", None, ("order_status",), numerator="order_value", denominator="order_rows")
    )
    return registry


register(
    "own_metrics",
    on_warehouse(
        lambda w: metric_query(
            w, MetricRequest(["order_rows", "orders_with_customer", "average_order", "value_per_order"], ["order_status"]),
            _own_registry(),
        ).select(
            "order_status", "order_rows", "orders_with_customer",
            F.col("average_order").cast("decimal(20,2)").alias("average_order"),
            F.col("value_per_order").cast("decimal(20,2)").alias("value_per_order"),
        )
    ),
    with_ctes(
        "SELECT order_status, count(*) AS order_rows, count(customer_id) AS orders_with_customer,"
        " CAST(CAST(CAST(sum(total_amount) AS DOUBLE) / count(*) AS DECIMAL(20,2)) AS DOUBLE) AS average_order,"
        " CAST(CAST(CAST(sum(total_amount) AS DOUBLE) / count(*) AS DECIMAL(20,2)) AS DOUBLE) AS value_per_order"
        " FROM v_orders GROUP BY order_status"
    ),
)
register(
    "capital_incl_investment",
    on_warehouse(lambda w: metric_query(w, MetricRequest(["capital_invested"], ["partner_name"]), _own_registry())),
    with_ctes(
        "SELECT partner_name, CAST(sum(amount) AS DOUBLE) AS capital_invested FROM v_partner_capital"
        " WHERE transaction_type IN ('CAPITAL', 'INVESTMENT') GROUP BY partner_name"
    ),
)
register(
    "tenant_filter",
    on_warehouse(
        lambda w: metric_query(
            w, MetricRequest(["total_expenses"], ["paid_by"], tenant_id="t-1", options={"view_tenant": "t-1", "require_tenant": True})
        )
    ),
    with_ctes(metric_sql(["total_expenses"], "v_expenses", ("paid_by",))),
)
register(
    "tenant_filter_other",
    on_warehouse(
        lambda w: metric_query(w, MetricRequest(["total_expenses"], ["paid_by"], tenant_id="t-2", options={"view_tenant": "t-1"}))
    ),
    with_ctes(metric_sql(["total_expenses"], "v_expenses", ("paid_by",), None, "FALSE")),
)



def _two_tenants(w: TpchWarehouse):
    """The warehouse as if two tenants shared it: odd days belong to one, even days to the other."""
    owner = F.when(F.col("date_key") % 2 == 1, "t-1").otherwise("t-2").alias("tenant_id")
    shared = {f: w[f].select("*", owner) for f in ("fact_expenses", "fact_sales", "fact_orders")}
    return ChainMap(shared, w)


for _name, _metrics, _view, _by in (
    ("tenant_rows", ["total_expenses"], "v_expenses", "paid_by"),
    ("tenant_rows_early_sum", ["gross_sales"], "v_sales", "product_name"),
    ("tenant_rows_counted", ["number_of_orders"], "v_orders", "collected_by"),
):
    register(
        _name,
        on_warehouse(lambda w, m=_metrics, b=_by: metric_query(_two_tenants(w), MetricRequest(m, [b], tenant_id="t-2"))),
        with_ctes(metric_sql(_metrics, _view, (_by,), None, "date_key % 2 = 0")),
    )

# period against period ---------------------------------------------------------------------

_MARCH = TimeRange(start=dt.date(1997, 3, 1), end=dt.date(1997, 3, 31))
for _mode, _low, _high in (
    ("previous_period", "1997-01-29", "1997-02-28"), ("same_period_last_year", "1996-03-01", "1996-03-31"),
):
    register(
        f"compare_{_mode}",
        on_warehouse(
            lambda w, m=_mode: compare_periods(w, MetricRequest(["number_of_orders"], ["collected_by"], time_range=_MARCH), m)
        ),
        with_ctes(
            f"""SELECT collected_by,
  count(DISTINCT order_id) FILTER (order_date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31') AS number_of_orders,
  count(DISTINCT order_id) FILTER (order_date BETWEEN DATE '{_low}' AND DATE '{_high}') AS previous_number_of_orders
FROM v_orders WHERE order_date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31' OR order_date BETWEEN DATE '{_low}' AND DATE '{_high}'
GROUP BY collected_by"""
        ),
    )

_HALF = TimeRange(start=dt.date(1997, 1, 1), end=dt.date(1997, 6, 30))
for _mode, _grain, _moved, _low, _high in (
    ("same_period_last_year", "monthly", "CAST(order_date + INTERVAL 12 MONTH AS DATE)", "1996-01-01", "1996-06-30"),
    ("previous_period", "weekly", "order_date + 181", "1996-07-04", "1996-12-31"),
    ("previous_period", "daily", "order_date + 181", "1996-07-04", "1996-12-31"),
):
    _unit = {"monthly": "month", "weekly": "week", "daily": "day"}[_grain]
    register(
        f"compare_{_mode}_{_grain}",
        on_warehouse(
            lambda w, m=_mode, g=_grain: compare_periods(
                w, MetricRequest(["number_of_orders"], ["collected_by"], time_grain=g, time_range=_HALF), m
            )
        ),
        with_ctes(
            f"""SELECT collected_by, period, count(DISTINCT order_id) FILTER (now) AS number_of_orders,
  count(DISTINCT order_id) FILTER (NOT now) AS previous_number_of_orders
FROM (SELECT collected_by, order_id, order_date >= DATE '1997-01-01' AS now,
  CAST(date_trunc('{_unit}', CASE WHEN order_date >= DATE '1997-01-01' THEN order_date ELSE {_moved} END) AS DATE) AS period
  FROM v_orders WHERE order_date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'
    OR order_date BETWEEN DATE '{_low}' AND DATE '{_high}') GROUP BY collected_by, period"""
        ),
    )

# joins kept or left out give the same rows
register(
    "metric_all_joins",
    on_warehouse(
        lambda w: metric_query(w, replace(MetricRequest(["total_purchases"], ["supplier_id"]), options={"all_joins": True}))
    ),
    with_ctes(metric_sql(["total_purchases"], "v_purchases", ("supplier_id",))),
)
