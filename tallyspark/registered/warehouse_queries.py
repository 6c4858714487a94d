"""Dimension and fact loads, views, checks of the loaded warehouse."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.functions.calendar import key_day
from tallyspark.operators import quality as q
from tallyspark.operators import reconcile
from tallyspark.operators.distinct import BITS, BUCKET, SKETCH, bitmaps, distinct_by_bitmap, distinct_by_sketch, sketches, standard_error
from tallyspark.operators.joins import join_split_hot_keys, missing_from
from tallyspark.operators.latest import latest_per_key
from tallyspark.operators.rules import Rule, enforce_constraints, return_reference_rule, table_constraints
from tallyspark.operators.upsert import assign_keys, upsert
from tallyspark.plans.dimensions import calendar, extend_calendar
from tallyspark.plans.facts import FACTS, unresolved_rows
from tallyspark.plans.kept_results import count_distinct, states_of
from tallyspark.plans.summary import small_daily_summary
from tallyspark.plans.table_digests import SIDES, digest_report, month_digests
from tallyspark.plans.timeranges import TimeRange
from tallyspark.plans.tpch_warehouse import LINE_STAGING, LINE_VERSION, SIMPLE_VERSION, TpchWarehouse
from tallyspark.plans.views import SUMMARY, VIEWS, compose_view, for_tenant, register_views
from tallyspark.registered.base import doubles, on_warehouse, register, table
from tallyspark.registered.ctes import with_ctes

# latest version -----------------------------------------------------------------

_LINE_COLUMNS = "l_shipdate l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus".split()

register(
    "latest_row_dedupe",
    lambda spark, folder: latest_per_key(
        table("lineitem")(spark, folder), ["l_orderkey", "l_linenumber"], _LINE_COLUMNS
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.col("l_shipdate").cast("date").alias("ship_day")),
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CAST(l_shipdate AS DATE) AS ship_day FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY {", ".join(c + " DESC NULLS LAST" for c in _LINE_COLUMNS)}) = 1""",
)

# fact loads: columns that are not amounts, then amounts --------------------------

FACT_COLUMNS = {
    "fact_orders": ("order_id date_key customer_key order_status collected_by",
                    "subtotal invoice_discount delivery_charge total_amount"),
    "fact_sales": ("order_id order_item_id date_key customer_key product_key location_key",
                   "quantity unit_price item_discount line_total gross_sales unit_cost cogs"),
    "fact_payments": ("payment_id date_key order_id customer_key cash_account_key payment_method", "amount"),
    "fact_returns": ("return_id date_key return_type order_id purchase_id customer_key location_key cash_account_key status",
                     "refund_amount due_adjustment cash_refund"),
    "fact_return_items": ("return_item_id return_id product_key", "quantity unit_price line_amount returned_cogs"),
    "fact_purchases": ("purchase_id purchase_item_id date_key supplier_key product_key location_key",
                       "quantity unit_cost item_discount line_total"),
    "fact_cash_transactions": ("transaction_id date_key cash_account_key transaction_type direction description created_by",
                               "amount"),
    "fact_expenses": ("expense_id date_key expense_category payment_method cash_account_key paid_by", "amount"),
    "fact_partner_capital": ("capital_transaction_id date_key partner_key cash_account_key transaction_type", "amount"),
    "fact_stock_movements": ("movement_id date_key product_key movement_type direction from_location_key to_location_key"
                             " reference_id", "quantity"),
}

for _fact, (_plain, _amounts) in FACT_COLUMNS.items():
    register(
        f"{_fact}_load",
        on_warehouse(lambda w, f=_fact, c=f"{_plain} {_amounts}": w[f].select(*c.split())),
        with_ctes(f"SELECT {doubles(_amounts, *_plain.split())} FROM {_fact}"),
    )

register(
    "returned_cogs",
    on_warehouse(
        lambda w: w["fact_return_items"]
        .join(w["dim_product"].select("product_key", "category"), "product_key")
        .groupBy("category")
        .agg(F.sum("returned_cogs").alias("returned_cogs"), F.count("*").alias("lines"))
    ),
    with_ctes(
        "SELECT category, CAST(sum(returned_cogs) AS DOUBLE) AS returned_cogs, count(*) AS lines"
        " FROM fact_return_items JOIN dim_product USING (product_key) GROUP BY category"
    ),
)

register(
    "surrogate_keys",
    on_warehouse(lambda w: assign_keys(w["fact_orders"].select("order_id"), ["order_id"], "order_key")),
    with_ctes(
        "SELECT row_number() OVER (ORDER BY substr(md5(order_id), 1, 3), order_id) AS order_key, order_id FROM fact_orders"
    ),
)


def _upserted_orders(w: TpchWarehouse):
    """Orders with even ids are there first; a later load brings every third id with a new total."""
    rows = w["fact_orders"].select("order_id", "total_amount")
    number = F.col("order_id").cast("bigint")
    there = assign_keys(rows.where(number % 2 == 0), ["order_id"], "order_key")
    load = rows.where(number % 3 == 0).withColumn("total_amount", (F.col("total_amount") + 1).cast("decimal(14,2)"))
    return upsert(there, load, ["order_id"], "order_key")


register(
    "fact_upsert",
    on_warehouse(_upserted_orders),
    with_ctes(
        """, base AS (SELECT order_id, total_amount, CAST(order_id AS BIGINT) AS n FROM fact_orders),
there AS (SELECT row_number() OVER (ORDER BY substr(md5(order_id), 1, 3), order_id) AS order_key, * FROM base WHERE n % 2 = 0),
fresh AS (SELECT (SELECT max(order_key) FROM there) + row_number() OVER (ORDER BY substr(md5(order_id), 1, 3), order_id)
  AS order_key, * FROM base WHERE n % 3 = 0 AND n % 2 <> 0)
SELECT order_key, order_id, CAST(total_amount + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS total_amount FROM there
UNION ALL SELECT order_key, order_id, CAST(total_amount + 1 AS DOUBLE) FROM fresh"""
     ),
)

# distinct counts from states of single days -----------------------------------------

def _quarter():
    return F.trunc(key_day(F.col("date_key")), "quarter").alias("quarter")


_CUSTOMERS = "SELECT CAST(date_trunc('quarter', sale_date) AS DATE) AS quarter, count(DISTINCT customer_id) AS customers FROM v_sales GROUP BY 1"

register(
    "distinct_by_bitmap",
    on_warehouse(
        lambda w: distinct_by_bitmap(
            bitmaps(w["fact_sales"], "customer_key", ["date_key"]).select(_quarter(), BUCKET, BITS), ["quarter"], "customers"
        )
    ),
    with_ctes(_CUSTOMERS),
)


def _sketched(w: TpchWarehouse):
    """Estimates from the sketches of single days, held against the exact counts."""
    days = sketches(w["fact_sales"].where("customer_key IS NOT NULL"), "customer_key", ["date_key"])
    estimated = distinct_by_sketch(days.select(_quarter(), SKETCH), ["quarter"], "estimate")
    counted = w["fact_sales"].groupBy(_quarter()).agg(F.count_distinct("customer_key").alias("customers"))
    off = F.abs(F.col("estimate") - F.col("customers"))
    return counted.join(estimated, "quarter").select("quarter", "customers", (off <= 4 * standard_error() * F.col("customers")).alias("close"))


register("distinct_by_sketch", on_warehouse(_sketched), with_ctes(_CUSTOMERS.replace(" FROM", ", true AS close FROM")))


def _purchases_of_days(w: TpchWarehouse):
    purchases = w["fact_purchases"]
    numbers = assign_keys(purchases.select("purchase_id").distinct(), ["purchase_id"], "purchase_number")
    days = states_of("purchase_transactions", purchases, numbers)
    return count_distinct(days, "purchase_transactions", TimeRange(start=dt.date(1996, 2, 10), end=dt.date(1997, 11, 20)), "monthly")


register(
    "distinct_over_a_range",
    on_warehouse(_purchases_of_days),
    with_ctes(
        "SELECT CAST(date_trunc('month', purchase_date) AS DATE) AS period, count(DISTINCT purchase_id) AS purchase_transactions FROM v_purchases"
        " WHERE purchase_date BETWEEN DATE '1996-02-10' AND DATE '1997-11-20' GROUP BY 1"
    ),
)

register(
    "sales_join_hot_keys",
    lambda spark, folder: join_split_hot_keys(
        table("lineitem")(spark, folder).select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").withColumn(
            "s_suppkey", F.when(F.col("l_orderkey") % 3 == 0, F.lit(1)).otherwise(F.col("l_suppkey"))
        ),
        table("supplier")(spark, folder).select("s_suppkey", "s_name"),
        "s_suppkey",
    ).groupBy("s_name").agg(F.count("*").alias("lines"), F.sum(F.col("l_extendedprice").cast("decimal(14,2)")).alias("amount")),
    """SELECT s_name, count(*) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) AS amount
FROM lineitem JOIN supplier ON s_suppkey = CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_suppkey END GROUP BY s_name""",
)

# dimensions ----------------------------------------------------------------------

def _calendar_of_data(w: TpchWarehouse):
    """The calendar of the orders, then made longer for the days of the events."""
    span = lambda name, c: w[name].agg(F.min(F.col(c).cast("date")), F.max(F.col(c).cast("date"))).first()
    orders, events = span("orders", "o_orderdate"), span("events", "ts")
    first = calendar(w.spark, *orders)
    return extend_calendar(first, calendar(w.spark, min(orders[0], events[0]), max(orders[1], events[1])))


register(
    "dim_date_calendar",
    on_warehouse(_calendar_of_data),
    with_ctes(
        """SELECT date_key, date, year, quarter, month, month_number, month_name, week, day, day_name, is_weekend FROM dim_date
WHERE date BETWEEN (SELECT least((SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT min(CAST(ts AS DATE)) FROM events)))
  AND (SELECT greatest((SELECT max(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(ts AS DATE)) FROM events)))"""
    ),
)
for _dim, _columns, _decimals in (
    ("dim_customer", "customer_key customer_id customer_name status", ""),
    ("dim_product", "product_key product_id product_name category unit",
     "current_selling_price current_cost_price opening_stock"),
    ("dim_supplier", "supplier_key supplier_id supplier_name active", ""),
    ("dim_partner", "partner_key partner_id partner_name active", ""),
    ("dim_cash_account", "cash_account_key cash_account_id account_name account_type owner_id active", ""),
    ("dim_location", "location_key stock_location_id location_name location_type partner_key active", ""),
):
    register(
        f"{_dim}_upsert",
        on_warehouse(lambda w, d=_dim, c=f"{_columns} {_decimals}": w[d].select(*c.split())),
        with_ctes(f"SELECT {doubles(_decimals, *_columns.split())} FROM {_dim}"),
    )


def _customer_changes(w: TpchWarehouse):
    """Two loads: the second renames some customers and brings new ones; first-seen times stay."""
    from tallyspark.plans.dimensions import load_dimension

    staged, number = w["stg_customer"], F.col("customer_id").cast("bigint")
    day1, day2 = (F.lit(f"2024-02-0{i} 00:00:00").cast("timestamp") for i in (1, 2))
    first = load_dimension("dim_customer", staged.where(number % 4 != 0), None, None, day1, SIMPLE_VERSION)
    second = staged.where(number % 2 == 0).withColumn("customer_name", F.concat(F.lit("new "), "customer_name"))
    result = load_dimension("dim_customer", second, first, None, day2, SIMPLE_VERSION)
    return result.select("customer_key", "customer_id", "customer_name", F.col("valid_from").cast("date").alias("valid_from"),
                         "is_current", F.col("valid_to").isNull().alias("open"))


register(
    "dim_customer_second_load",
    on_warehouse(_customer_changes),
    """WITH c AS (SELECT c_custkey AS n, CAST(c_custkey AS VARCHAR) AS customer_id, c_name FROM customer),
old AS (SELECT row_number() OVER (ORDER BY substr(md5(customer_id), 1, 3), customer_id) AS customer_key, * FROM c WHERE n % 4 <> 0),
new AS (SELECT (SELECT max(customer_key) FROM old) + row_number() OVER (ORDER BY substr(md5(customer_id), 1, 3), customer_id)
  AS customer_key, * FROM c WHERE n % 4 = 0)
SELECT customer_key, customer_id, CASE WHEN n % 2 = 0 THEN 'new ' || c_name ELSE c_name END AS customer_name,
  DATE '2024-02-01' AS valid_from, TRUE AS is_current, TRUE AS open FROM old
UNION ALL SELECT customer_key, customer_id, 'new ' || c_name, DATE '2024-02-02', TRUE, TRUE FROM new""",
)

# views ---------------------------------------------------------------------------

# every column of every view; the facts carry their keys
_DECIMALS = set(
    "subtotal invoice_discount delivery_charge total_amount calculated_order_amount quantity unit_price item_discount line_total"
    " gross_sales unit_cost cogs calculated_net_line_amount amount refund_amount due_adjustment cash_refund line_amount"
    " returned_cogs gross_purchase_amount calculated_net_purchase_amount".split()
)
_TIMES = ("ingested_at", "source_created_at", "created_at")


def _whole_view(w: TpchWarehouse, view: str):
    fact = VIEW_FACTS[view]
    tables, finish = w.with_late_keys(fact) if FACTS[fact].joined else (w.with_keys(fact), None)
    rows = compose_view(tables, view, all_joins=True, finish=finish)
    return rows.withColumns({c: F.col(c).cast("string") for c in _TIMES if c in rows.columns})


def _whole_view_sql(view: str) -> str:
    cast = lambda c: f"CAST({c} AS DOUBLE) AS {c}" if c in _DECIMALS else f"CAST({c} AS VARCHAR) AS {c}" if c in _TIMES else c
    return f"SELECT {', '.join(map(cast, VIEWS[view].columns))} FROM {view}"


VIEW_FACTS = {v: v.replace("v_", "fact_", 1) for v in VIEWS}
for _view in VIEWS:
    register(_view, on_warehouse(lambda w, v=_view: _whole_view(w, v), together=_view == "v_return_items"), with_ctes(_whole_view_sql(_view)))

SUMMARY_PLAIN = ("date_key business_date year quarter month month_name week day day_name is_weekend total_orders"
                 " total_customer_returns total_supplier_returns total_purchases")
SUMMARY_AMOUNTS = ("total_order_amount total_sales_amount total_sales_quantity total_payments total_customer_return_amount"
                   " total_customer_cash_refund total_customer_due_adjustment total_supplier_return_amount"
                   " total_purchase_amount total_purchase_quantity total_expenses capital_added capital_withdrawn"
                   " total_cash_in total_cash_out net_sales gross_business_margin operating_result")
register(
    "daily_business_summary",
    on_warehouse(lambda w: compose_view(w, SUMMARY, f"{SUMMARY_PLAIN} {SUMMARY_AMOUNTS}".split())),
    with_ctes(f"SELECT {doubles(SUMMARY_AMOUNTS, *SUMMARY_PLAIN.split())} FROM {SUMMARY}"),
)
register(
    "small_daily_summary",
    on_warehouse(small_daily_summary),
    with_ctes(
        """SELECT d.date_key, d.date AS business_date, coalesce(o.n, 0) AS total_orders,
  CAST(coalesce(o.a, 0) AS DOUBLE) AS total_sales, CAST(coalesce(p.a, 0) AS DOUBLE) AS total_payments,
  coalesce(r.n, 0) AS total_returns, CAST(coalesce(r.a, 0) AS DOUBLE) AS total_return_amount,
  CAST(coalesce(r.c, 0) AS DOUBLE) AS total_cash_refund, CAST(coalesce(r.u, 0) AS DOUBLE) AS total_due_adjustment,
  coalesce(b.n, 0) AS total_purchases, CAST(coalesce(b.a, 0) AS DOUBLE) AS total_purchase_amount,
  CAST(coalesce(o.a, 0) - coalesce(r.a, 0) AS DOUBLE) AS net_sales,
  CAST(coalesce(o.a, 0) - coalesce(r.a, 0) - coalesce(b.a, 0) AS DOUBLE) AS gross_business_margin
FROM dim_date d
LEFT JOIN (SELECT date_key, count(*) n, sum(total_amount) a FROM fact_orders GROUP BY 1) o USING (date_key)
LEFT JOIN (SELECT date_key, sum(amount) a FROM fact_payments GROUP BY 1) p USING (date_key)
LEFT JOIN (SELECT date_key, count(*) n, sum(refund_amount) a, sum(cash_refund) c, sum(due_adjustment) u FROM fact_returns
  GROUP BY 1) r USING (date_key)
LEFT JOIN (SELECT date_key, count(DISTINCT purchase_id) n, sum(line_total) a FROM fact_purchases GROUP BY 1) b USING (date_key)"""
    ),
)
TENANT = "00000000-0000-0000-0000-000000000001"


def _tenant_views(w: TpchWarehouse):
    """All eleven views behind the wrapper: per view, tenant and month, its rows and days."""
    parts = []
    for name in (*VIEWS, SUMMARY):
        view = for_tenant(compose_view(w, name, ["date_key"]), TENANT)
        month = F.floor(F.col("date_key") / 100).cast("bigint").alias("month")
        parts.append(view.groupBy(F.lit(name).alias("view"), "tenant_id", month).agg(
            F.count("*").alias("rows"), F.count_distinct("date_key").alias("days")
        ))
    return q.stack_reports(parts)


register(
    "tenant_view",
    on_warehouse(_tenant_views),
    with_ctes(" UNION ALL ".join(
        f"SELECT '{v}' AS view, '{TENANT}' AS tenant_id, date_key // 100 AS month, count(*) AS rows, count(DISTINCT date_key) AS days"
        f" FROM {v} GROUP BY date_key // 100" for v in (*VIEWS, SUMMARY)
    )),
)

# constraints ----------------------------------------------------------------------

# what each fact is made to break, by its own values: column -> (condition, broken value), in Spark and DuckDB alike
_BREAKS = {
    "fact_orders": {"subtotal": ("total_amount > 150000", "-total_amount"), "invoice_discount": ("date_key % 7 = 0", "-1"),
                    "delivery_charge": ("date_key % 11 = 0", "-0.01"), "total_amount": ("subtotal > 200000", "-subtotal")},
    "fact_payments": {"amount": ("date_key % 5 = 0", "-amount - 1")},
    "fact_purchases": {"quantity": ("quantity > 40", "0"), "unit_cost": ("item_discount > 5000", "-unit_cost"),
                       "item_discount": ("quantity < 5", "-1"), "line_total": ("date_key % 9 = 0", "-1")},
    "fact_returns": {"refund_amount": ("date_key % 10 = 0", "-1"), "due_adjustment": ("refund_amount > 50000", "-due_adjustment - 1"),
                     "cash_refund": ("refund_amount < 5000", "-1")},
    "fact_return_items": {"quantity": ("quantity > 45", "-quantity"), "unit_price": ("quantity < 3", "-1"),
                          "line_amount": ("unit_price > 50000", "-1"), "returned_cogs": ("quantity > 30", "-0.01")},
    "fact_stock_movements": {"quantity": ("quantity > 25", "quantity - 40"), "direction": ("date_key % 6 = 0", "'SIDEWAYS'")},
    "fact_cash_transactions": {"amount": ("date_key % 8 = 0", "0"), "direction": ("amount > 50", "lower(direction)")},
    "fact_expenses": {"amount": ("amount < 20", "amount - 20")},
    "fact_partner_capital": {"amount": ("transaction_type = 'CAPITAL'", "amount - 50")},
}
_RULE_SQL = {
    "not_negative": "CASE WHEN {0} < 0 THEN '{0} cannot be negative.' END",
    "positive": "CASE WHEN {0} <= 0 THEN '{0} must be greater than zero.' END",
    "direction": "CASE WHEN {0} NOT IN ('IN', 'OUT') THEN '{0} must be one of IN, OUT.' END",
}
_RULE_OF = {"quantity": "positive", "direction": "direction"}
_POSITIVE_AMOUNT = {"fact_cash_transactions", "fact_expenses", "fact_partner_capital"}


def _broken_fact(w: TpchWarehouse, fact: str):
    """The rows that break rules once their values are spoiled, and one row that counts those kept."""
    columns, key = _BREAKS[fact], F.concat_ws("|", *FACTS[fact].business_key).alias("row")
    more = [c for c in ("return_type", "order_id", "purchase_id") if fact == "fact_returns"]
    spoiled = w[fact].select(key, *more, *[F.expr(f"CASE WHEN {cond} THEN {bad} ELSE {c} END").alias(c) for c, (cond, bad) in columns.items()])
    kept, broken = enforce_constraints(spoiled, table_constraints()[fact])
    return broken.select("row", F.array_join("errors", "; ").alias("errors"), F.lit(1).cast("bigint").alias("rows")).unionByName(
        kept.agg(F.lit("kept").alias("row"), F.lit("").alias("errors"), F.count("*").alias("rows"))
    )


def _broken_fact_sql(fact: str) -> str:
    def rule(c: str) -> str:
        kind = "positive" if c == "amount" and fact in _POSITIVE_AMOUNT else _RULE_OF.get(c, "not_negative")
        return _RULE_SQL[kind].format(c)

    key = " || '|' || ".join(FACTS[fact].business_key)
    spoiled = ", ".join(f"CASE WHEN {cond} THEN {bad} ELSE {c} END AS {c}" for c, (cond, bad) in _BREAKS[fact].items())
    errors = f"concat_ws('; ', {', '.join(map(rule, _BREAKS[fact]))})"
    return f""", s AS (SELECT {key} AS row, {spoiled} FROM {fact}), e AS (SELECT row, {errors} AS errors FROM s)
SELECT row, errors, CAST(1 AS BIGINT) AS rows FROM e WHERE errors <> ''
UNION ALL SELECT 'kept', '', count(*) FROM e WHERE errors = ''"""


for _fact in _BREAKS:
    register(f"constraints_{_fact}", on_warehouse(lambda w, f=_fact: _broken_fact(w, f)), with_ctes(_broken_fact_sql(_fact)))

register(
    "constraint_return_ref",
    # every fifth order's returns lose their reference and must be caught
    on_warehouse(
        lambda w: enforce_constraints(
            w["fact_returns"].select(
                "return_id", "return_type",
                F.when(F.split("return_id", "-")[0].cast("bigint") % 5 != 0, F.col("order_id")).alias("order_id"),
                "purchase_id",
            ),
            [return_reference_rule()],
        )[1].select("return_id", F.array_join("errors", "; ").alias("errors"))
    ),
    with_ctes(
        "SELECT return_id, 'return reference does not fit return_type.' AS errors FROM fact_returns"
        " WHERE return_type = 'CUSTOMER_RETURN' AND CAST(split_part(return_id, '-', 1) AS BIGINT) % 5 = 0"
    ),
)
register(
    "constraint_quarantine",
    lambda spark, folder: enforce_constraints(
        table("customer")(spark, folder).select("c_custkey", "c_acctbal", "c_mktsegment"),
        [
            Rule("c_acctbal cannot be negative.", F.col("c_acctbal") < 0),
            Rule("c_mktsegment is not served.", F.col("c_mktsegment") == "MACHINERY"),
        ],
    )[1].select("c_custkey", F.array_join("errors", "; ").alias("errors")),
    """SELECT c_custkey, concat_ws('; ', CASE WHEN c_acctbal < 0 THEN 'c_acctbal cannot be negative.' END,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'c_mktsegment is not served.' END) AS errors
FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'MACHINERY'""",
)

# unresolved rows -------------------------------------------------------------------

register(
    "unresolved_purchases",
    on_warehouse(lambda w: unresolved_rows("fact_purchases", w)),
    with_ctes(
        "SELECT line_id AS purchase_item_id FROM line_latest"
        " WHERE line_id NOT IN (SELECT purchase_item_id FROM fact_purchases)"
    ),
)
register(
    "unresolved_returns",
    on_warehouse(lambda w: unresolved_rows("fact_returns", w)),
    with_ctes("SELECT line_id AS return_id FROM return_latest WHERE line_id NOT IN (SELECT return_id FROM fact_returns)"),
)
register(
    "incremental_anti",
    lambda spark, folder: missing_from(
        table("orders")(spark, folder).select("o_orderkey", "o_custkey"),
        table("lineitem")(spark, folder).where(F.col("l_returnflag") == "R"),
        ["o_orderkey"], ["l_orderkey"],
    ),
    "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS"
    " (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
)

# data quality ------------------------------------------------------------------------

REPORT = ["check_name", "status", "severity", "affected_rows"]


def _report(name: str, count_sql: str, status: str, severity: str) -> str:
    return f"""SELECT '{name}' AS check_name, CASE WHEN n > 0 THEN '{status}' ELSE 'PASS' END AS status,
  CASE WHEN n > 0 THEN '{severity}' ELSE 'INFO' END AS severity, CAST(n AS BIGINT) AS affected_rows FROM ({count_sql})"""


register(
    "dq_duplicates",
    lambda spark, folder: q.stack_reports(
        [
            q.duplicate_check(table("lineitem")(spark, folder), "lineitem", "l_orderkey"),
            q.duplicate_check(table("orders")(spark, folder), "orders", "o_orderkey"),
            q.duplicate_check(table("part")(spark, folder), "part", "p_name", expected_unique=False),
        ]
    ).select(*REPORT),
    " UNION ALL ".join(
        _report(f"duplicate_count:{t}.{c}", f"SELECT count(*) n FROM (SELECT {c} FROM {t} GROUP BY 1 HAVING count(*) > 1)", s, v)
        for t, c, s, v in (
            ("lineitem", "l_orderkey", "FAIL", "ERROR"), ("orders", "o_orderkey", "FAIL", "ERROR"),
            ("part", "p_name", "WARNING", "WARNING"),
        )
    ),
)
register(
    "dq_orphans",
    lambda spark, folder: q.stack_reports(
        [
            q.orphan_check(
                table("orders")(spark, folder), "orders", "o_orderkey",
                table("lineitem")(spark, folder).where(F.col("l_returnflag") == "A"), "lineitem", "l_orderkey"),
            q.orphan_check(
                table("lineitem")(spark, folder), "lineitem", "l_orderkey", table("orders")(spark, folder), "orders",
                "o_orderkey"),
        ]
    ).select(*REPORT),
    _report(
        "orphan_check:orders->lineitem",
        "SELECT count(*) n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')",
        "FAIL", "ERROR",
    ) + " UNION ALL " + _report(
        "orphan_check:lineitem->orders",
        "SELECT count(*) n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)", "FAIL", "ERROR",
    ),
)
register(
    "dq_null_rate",
    on_warehouse(
        lambda w: q.run_table_checks(
            w["fact_orders"],
            [
                q.null_rate("fact_orders", "customer_key", 5.0),
                q.null_rate("fact_orders", "date_key"),
                q.not_null("fact_orders", "customer_key"),
            ],
        ).select(*REPORT)
    ),
    with_ctes(
        """, c AS (SELECT count(*) AS rows, count(*) FILTER (customer_key IS NULL) AS nulls FROM fact_orders)
SELECT 'null_rate:fact_orders.customer_key' AS check_name, CASE WHEN 100.0 * nulls / rows > 5 THEN 'WARNING' ELSE 'PASS' END AS status,
  CASE WHEN 100.0 * nulls / rows > 5 THEN 'WARNING' ELSE 'INFO' END AS severity,
  CASE WHEN 100.0 * nulls / rows > 5 THEN nulls ELSE 0 END AS affected_rows FROM c
UNION ALL SELECT 'null_rate:fact_orders.date_key', 'PASS', 'INFO', 0
UNION ALL SELECT 'nullability:fact_orders.customer_key', CASE WHEN nulls > 0 THEN 'FAIL' ELSE 'PASS' END,
  CASE WHEN nulls > 0 THEN 'ERROR' ELSE 'INFO' END, nulls FROM c"""
     ),
)
register(
    "dq_freshness",
    lambda spark, folder: q.stack_reports(
        [
            q.run_table_checks(
                table("events")(spark, folder), [q.freshness("events", "ts", 48, F.lit("2024-01-31 12:00:00").cast("timestamp"))]
            ),
            q.run_table_checks(
                table("orders")(spark, folder),
                [q.freshness("orders", "o_orderdate", 24, F.lit("2024-01-31 12:00:00").cast("timestamp"))],
            ),
        ]
    ).select(*REPORT),
    """SELECT 'freshness:' || t AS check_name, CASE WHEN stale THEN 'WARNING' ELSE 'PASS' END AS status,
  CASE WHEN stale THEN 'WARNING' ELSE 'INFO' END AS severity, CASE WHEN stale THEN 1 ELSE 0 END AS affected_rows
FROM (SELECT 'events' AS t, epoch(TIMESTAMP '2024-01-31 12:00:00' - max(ts)) > 48 * 3600 AS stale FROM events
UNION ALL SELECT 'orders', epoch(TIMESTAMP '2024-01-31 12:00:00' - max(o_orderdate)) > 24 * 3600 FROM orders)""",
)
register(
    "dq_amount_rule",
    on_warehouse(
        lambda w: q.run_table_checks(
            w["fact_sales"],
            [
                q.line_amount("fact_sales", "quantity", "unit_price", "line_total"),
                q.line_amount("fact_sales_net", "quantity", "unit_price", "line_total", discount="item_discount"),
            ],
        ).select(*REPORT)
    ),
    with_ctes(
        _report(
            "sales_amount_rule:fact_sales",
            "SELECT count(*) FILTER (abs(quantity * unit_price - line_total) > 0.01) AS n FROM fact_sales", "FAIL", "ERROR")
        + " UNION ALL "
        + _report(
            "sales_amount_rule:fact_sales_net",
            "SELECT count(*) FILTER (abs(quantity * unit_price - item_discount - line_total) > 0.01) AS n FROM fact_sales",
            "FAIL", "ERROR")
    ),
)
register(
    "dq_range",
    lambda spark, folder: q.run_table_checks(
        table("lineitem")(spark, folder),
        [q.value_range("lineitem", "l_quantity", 5, 45), q.value_range("lineitem", "l_discount", 0, 1)],
    ).select(*REPORT),
    _report("anomaly_threshold:lineitem.l_quantity",
            "SELECT count(*) FILTER (l_quantity < 5 OR l_quantity > 45) AS n FROM lineitem", "WARNING", "WARNING")
    + " UNION ALL "
    + _report("anomaly_threshold:lineitem.l_discount",
              "SELECT count(*) FILTER (l_discount < 0 OR l_discount > 1) AS n FROM lineitem", "WARNING", "WARNING"),
)


def _checked_line_table(w: TpchWarehouse):
    registry = q.CheckRegistry()
    registry.register(
        "columns", lambda t: q.columns_exist(t["lineitem"], "lineitem", ["l_orderkey", "l_linenumber", "l_comment"])
    )
    registry.register("types", lambda t: q.column_types(t["lineitem"], "lineitem", {"l_orderkey": "bigint", "l_tax": "double"}))
    registry.register("exists", lambda t: q.table_exists(w.spark, t, "lineitem"))
    registry.register(
        "values",
        lambda t: q.run_table_checks(
            t["lineitem"],
            [q.value_range("lineitem", "l_quantity", 5, 45), q.not_null("lineitem", "l_shipdate"), q.null_rate("lineitem", "l_tax")],
        ),
    )
    registry.register("keys", lambda t: q.duplicate_check(t["lineitem"], "lineitem", "l_orderkey", expected_unique=False))
    return registry.run(w)


_CHECKED = (
    "SELECT 'required_columns:lineitem' AS check_name, 'FAIL' AS status, 'ERROR' AS severity, CAST(1 AS BIGINT) AS affected_rows"
    " UNION ALL SELECT 'column_types:lineitem', 'PASS', 'INFO', 0 UNION ALL SELECT 'table_exists:lineitem', 'PASS', 'INFO', 0 UNION ALL "
    + _report("anomaly_threshold:lineitem.l_quantity",
              "SELECT count(*) FILTER (l_quantity < 5 OR l_quantity > 45) AS n FROM lineitem", "WARNING", "WARNING")
    + " UNION ALL " + _report("nullability:lineitem.l_shipdate",
                              "SELECT count(*) FILTER (l_shipdate IS NULL) AS n FROM lineitem", "FAIL", "ERROR")
    + " UNION ALL " + _report("null_rate:lineitem.l_tax",
                              "SELECT count(*) FILTER (l_tax IS NULL) AS n FROM lineitem", "WARNING", "WARNING")
    + " UNION ALL " + _report(
        "duplicate_count:lineitem.l_orderkey",
        "SELECT count(*) n FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)", "WARNING", "WARNING")
)
register("dq_report", on_warehouse(lambda w: _checked_line_table(w).select(*REPORT)), _CHECKED)
register(
    "dq_report_status",
    on_warehouse(lambda w: q.report_status(_checked_line_table(w))),
    f"""SELECT CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARNING') THEN 'WARNING' ELSE 'PASS' END AS status,
  count(*) AS total_count, count(*) FILTER (status = 'PASS') AS pass_count, count(*) FILTER (status = 'WARNING') AS warning_count,
  count(*) FILTER (status = 'FAIL') AS fail_count FROM ({_CHECKED})""",
)
def _structure(w: TpchWarehouse):
    """The report over sound tables, and over a warehouse whose sales lost a column, a type and some values."""
    tables = w.with_keys("fact_orders", "fact_sales")
    registered = register_views(w.with_keys(*FACTS))
    spoils = {
        "quantity": F.col("quantity").cast("double"), "line_total": F.when(F.col("line_total") > 1000, F.col("line_total")),
    }
    spoiled = tables["fact_sales"].drop("unit_cost").withColumns(spoils)
    names = [c for c in q.CORE_NOT_NULL["fact_sales"] if c != "unit_cost"]
    # the spoiled rows are judged in the pass over the sound ones, which numbers and sorts all sales
    nulls = [q.not_null("broken_sales", c, spoils.get(c)) for c in names]
    whole = q.warehouse_structure(w.spark, tables, also={"fact_sales": nulls})
    broken = q.stack_reports([
        q.columns_exist(spoiled, "broken_sales", q.CORE_NOT_NULL["fact_sales"]),
        q.column_types(spoiled, "broken_sales", q.core_types("fact_sales")),
        q.view_exists(w.spark, "v_missing_view"),
    ])
    assert set(registered) == {*VIEWS, SUMMARY}
    return whole.unionByName(broken).select(*REPORT)


def _structure_sql() -> str:
    line = lambda name, n=0: (
        f"SELECT '{name}' AS check_name, '{'FAIL' if n else 'PASS'}' AS status, '{'ERROR' if n else 'INFO'}' AS severity, CAST({n} AS BIGINT) AS affected_rows"
    )
    parts = [line(f"table_exists:{t}") for t in q.CORE_TABLES] + [line(f"view_exists:{v}") for v in q.CORE_VIEWS]
    parts += [line(f"column_types:{t}") for t in q.CORE_TYPES]
    # dim columns that the SQL tables leave out are constants of the load
    parts += [line(f"nullability:{t}.{c}") for t, columns in q.CORE_NOT_NULL.items() for c in columns if c in ("valid_from", "is_current")]
    parts += [
        _report(f"nullability:{t}.{c}", f"SELECT count(*) FILTER ({c} IS NULL) AS n FROM {t}", "FAIL", "ERROR")
        for t, columns in q.CORE_NOT_NULL.items() for c in columns if c not in ("valid_from", "is_current")
    ]
    parts += [line("required_columns:broken_sales", 1), line("column_types:broken_sales", 2), line("view_exists:v_missing_view", 1)]
    parts += [
        _report(f"nullability:broken_sales.{c}", f"SELECT count(*) FILTER ({'line_total <= 1000' if c == 'line_total' else f'{c} IS NULL'}) AS n FROM fact_sales",
                "FAIL", "ERROR")
        for c in q.CORE_NOT_NULL["fact_sales"] if c != "unit_cost"
    ]
    return " UNION ALL ".join(parts)


register("dq_warehouse_structure", on_warehouse(_structure), with_ctes(_structure_sql()))

# reconciliation ---------------------------------------------------------------------


def version_of(staging: str):
    return LINE_VERSION if staging in LINE_STAGING else SIMPLE_VERSION


_STAGED_COUNT = {
    "dim_customer": "SELECT count(*) FROM customer", "dim_product": "SELECT count(*) FROM part",
    "dim_supplier": "SELECT count(*) FROM supplier", "dim_partner": "SELECT count(*) FROM region",
    "dim_location": "SELECT count(*) FROM nation",
    "dim_cash_account": "SELECT count(DISTINCT json_extract_string(props, '$.k')) FROM events",
    "fact_orders": "SELECT count(DISTINCT o_orderkey) FROM orders",
    "fact_sales": "SELECT count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem",
    "fact_payments": "SELECT count(*) FROM events WHERE event_type = 'purchase'",
    "fact_returns": "SELECT count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem WHERE l_returnflag <> 'N'",
    "fact_return_items": "SELECT count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem WHERE l_returnflag <> 'N'",
    "fact_purchases": "SELECT count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem",
    "fact_cash_transactions": "SELECT count(*) FROM events WHERE event_type IN ('purchase', 'error')",
    "fact_expenses": "SELECT count(*) FROM events WHERE event_type = 'error'",
    "fact_partner_capital": "SELECT count(*) FROM events WHERE event_type IN ('signup', 'view', 'click')",
    "fact_stock_movements": "SELECT count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem",
}
_CURRENT = {"dim_customer": "TRUE", "dim_product": "TRUE"}


def _counts(label: str, prefix: str) -> str:
    rows = [
        f"SELECT '{n}' AS {label}, ({s}) AS expected_count, (SELECT count(*) FROM {n}"
        + (f" WHERE {_CURRENT.get(n, 'active')}" if prefix == "dim_" else "")
        + ") AS actual_count"
        for n, s in _STAGED_COUNT.items()
        if n.startswith(prefix)
    ]
    return (
        f"SELECT {label}, expected_count, actual_count, 0 AS duplicate_count, expected_count = actual_count AS is_valid FROM ("
        + " UNION ALL ".join(rows) + ")"
    )


_TOTALS = {
    "order_total_amount": ("SELECT sum(CAST(o_totalprice AS DECIMAL(14,2))) FROM orders", "total_amount", "fact_orders"),
    "payment_amount": ("SELECT sum(CAST(value AS DECIMAL(14,2))) FROM events WHERE event_type = 'purchase'", "amount",
                       "fact_payments"),
    "return_refund_amount": ("SELECT sum(price) FROM return_latest", "refund_amount", "fact_returns"),
    "purchase_line_total": ("SELECT sum(CAST(quantity * price AS DECIMAL(14,2))) FILTER (flag <> 'N') FROM line_latest",
                            "line_total", "fact_purchases"),
    "expense_amount": ("SELECT sum(CAST(value AS DECIMAL(14,2))) FROM events WHERE event_type = 'error'", "amount",
                       "fact_expenses"),
    "cash_transaction_amount": (
        "SELECT sum(CAST(value AS DECIMAL(14,2))) FROM events WHERE event_type IN ('purchase', 'error')", "amount",
        "fact_cash_transactions"),
}
_TOTALS_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS metric_name, ({src}) AS source_value, (SELECT sum({c}) FROM {f}) AS warehouse_value"
    for n, (src, c, f) in _TOTALS.items()
)
_TOTALS_SQL = f"""SELECT metric_name, CAST(source_value AS DOUBLE) AS source_value, CAST(warehouse_value AS DOUBLE) AS warehouse_value,
  CAST(source_value - warehouse_value AS DOUBLE) AS difference, source_value = warehouse_value AS is_valid FROM ({_TOTALS_SQL})"""

register("dim_validation", on_warehouse(reconcile.dimension_report), with_ctes(_counts("dimension_name", "dim_")))
register("fact_validation", on_warehouse(reconcile.fact_report), with_ctes(_counts("fact_name", "fact_")))
register("reconciliation", on_warehouse(lambda w: reconcile.totals_report(w, version_of)), with_ctes(_TOTALS_SQL))
register(
    "warehouse_validation",
    on_warehouse(lambda w: reconcile.warehouse_report(w, version_of), together=True),
    with_ctes(
        f"""SELECT coalesce(check_group, 'all') AS check_group, bool_and(is_valid) AS is_valid, count(*) AS check_count FROM (
SELECT 'dimensions' AS check_group, is_valid FROM ({_counts("dimension_name", "dim_")})
UNION ALL SELECT 'facts', is_valid FROM ({_counts("fact_name", "fact_")})
UNION ALL SELECT 'totals', is_valid FROM ({_TOTALS_SQL})) GROUP BY ROLLUP (check_group)"""
    ),
)

# digests ------------------------------------------------------------------------------

_EVENT_ROWS = "SELECT CAST(event_id AS VARCHAR) AS k, {0} AS a FROM events WHERE event_type IN ({1})"
_EVENT_VALUE = "CAST(value AS DECIMAL(14,2))"
# fact -> the latest staged rows: key and amount
_STAGED_ROWS = {
    "fact_orders": "SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(o_totalprice AS DECIMAL(14,2)) AS a FROM orders",
    "fact_sales": "SELECT line_id AS k, NULL AS a FROM line_latest",
    "fact_payments": _EVENT_ROWS.format(_EVENT_VALUE, "'purchase'"),
    "fact_returns": "SELECT line_id AS k, price AS a FROM return_latest",
    "fact_return_items": "SELECT line_id AS k, NULL AS a FROM return_latest",
    "fact_purchases": "SELECT line_id AS k, CASE WHEN flag <> 'N' THEN CAST(quantity * price AS DECIMAL(14,2)) END AS a FROM line_latest",
    "fact_cash_transactions": _EVENT_ROWS.format(_EVENT_VALUE, "'purchase', 'error'"),
    "fact_expenses": _EVENT_ROWS.format(_EVENT_VALUE, "'error'"),
    "fact_partner_capital": _EVENT_ROWS.format("NULL", "'signup', 'view', 'click'"),
    "fact_stock_movements": "SELECT line_id AS k, NULL AS a FROM line_latest",
}


def _digest_validation_sql() -> str:
    """Counts and sums side by side; rows are compared as multisets, not by hashes."""
    parts = []
    for fact, side in SIDES.items():
        amount = side.amount or "NULL"
        zero = "CAST(coalesce({0}, 0) AS DECIMAL(38,2))" if side.amount else "NULL"
        staged = f"SELECT k, {zero.format('a')} AS a FROM ({_STAGED_ROWS[fact]})"
        core = f"SELECT {side.key} AS k, {zero.format(amount)} AS a FROM {fact}"
        one_way = "SELECT count(*) FROM ({0} EXCEPT ALL {1})"
        parts.append(
            f"SELECT '{fact}' AS fact_name, (SELECT count(*) FROM ({staged})) AS expected_count, (SELECT count(*) FROM ({core})) AS actual_count,"
            f" CAST((SELECT sum(a) FROM ({staged})) AS DOUBLE) AS source_value, CAST((SELECT sum(a) FROM ({core})) AS DOUBLE) AS warehouse_value,"
            f" ({one_way.format(staged, core)}) + ({one_way.format(core, staged)}) = 0 AS same_rows"
        )
    return f"SELECT *, same_rows AS is_valid FROM ({' UNION ALL '.join(parts)})"


register("digest_validation", on_warehouse(lambda w: digest_report(w, version_of), together=True), with_ctes(_digest_validation_sql()))

_DIGESTED = ("fact_orders", "fact_sales", "fact_payments", "fact_expenses")


def _month_digests(w: TpchWarehouse):
    parts = [month_digests(f, w[f]).select(F.lit(f).alias("fact_name"), "load_month", "row_count", "total", F.col("digest").cast("string")) for f in _DIGESTED]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _told(value: str) -> str:
    return f"coalesce(length({value}) || ':' || {value}, '-')"


def _month_digest_sql(fact: str) -> str:
    side = SIDES[fact]
    amount = f"CAST(coalesce({side.amount}, 0) AS DECIMAL(38,2))" if side.amount else "NULL"
    text = _told(side.key) + (f" || ',' || {_told(f'CAST({amount} AS VARCHAR)')}" if side.amount else "")
    return (
        f"SELECT '{fact}' AS fact_name, date_key // 100 AS load_month, count(*) AS row_count, CAST(sum({amount}) AS DOUBLE) AS total,"
        f" CAST(sum(CAST(CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM {fact} GROUP BY ALL"
    )


register("digests_by_month", on_warehouse(_month_digests), with_ctes(" UNION ALL ".join(map(_month_digest_sql, _DIGESTED))))


def _integrity_sql(fact: str) -> str:
    key = FACTS[fact].business_key
    parts = [f"SELECT '{fact}' AS fact, 'unique {', '.join(key)}' AS rule, count(*) - count(DISTINCT ({', '.join(key)})) AS broken_rows FROM {fact}"]
    for column, target in reconcile.FOREIGN_KEYS[fact].items():
        known = column.removeprefix("from_").removeprefix("to_")
        parts.append(
            f"SELECT '{fact}', '{column} in {target}', count(*) FROM {fact} WHERE {column} IS NOT NULL"
            f" AND {column} NOT IN (SELECT {known} FROM {target})"
        )
    return " UNION ALL ".join(parts)


for _fact in FACTS:
    register(f"integrity_{_fact}", on_warehouse(lambda w, f=_fact: reconcile.fact_integrity(w, f)), with_ctes(_integrity_sql(_fact)))

# the fact whose dangling keys must be found: sales against the parts of one category only
register(
    "integrity_broken_keys",
    on_warehouse(
        lambda w: reconcile.fact_integrity(
            {**{n: w[n] for n in ("fact_sales", "dim_date", "dim_customer", "dim_location")},
             "dim_product": w["dim_product"].where("category = 'PROMO'")},
            "fact_sales",
        ).where("broken_rows > 0")
    ),
    with_ctes(
        "SELECT 'fact_sales' AS fact, 'product_key in dim_product' AS rule, count(*) AS broken_rows FROM fact_sales"
        " WHERE product_key NOT IN (SELECT product_key FROM dim_product WHERE category = 'PROMO')"
    ),
)
