"""A tiny warehouse with known totals."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from tallyspark.plans.dimensions import calendar

SALES = [("Nuts", "1000.00", "2026-01-15"), ("Nuts", "500.00", "2026-02-10"), ("Snacks", "750.25", "2026-01-20"), ("Snacks", "900.00", "2026-02-05")]
EXPENSES = [("Rent", "300.00", "2026-01-05"), ("Utilities", "60.00", "2026-01-18"), ("Rent", "300.00", "2026-02-05")]
CASH = [("10000.00", "IN", "2026-01-10"), ("12000.00", "IN", "2026-02-10"), ("7000.00", "OUT", "2026-01-12"), ("5000.00", "OUT", "2026-03-01")]


def _key(text: str) -> int:
    return int(text.replace("-", ""))


def golden_tables(spark) -> dict:
    products = {"Nuts": 1, "Snacks": 2}
    empty = {
        "fact_orders": "order_id string, date_key int, customer_key bigint, total_amount decimal(14,2)",
        "fact_payments": "payment_id string, date_key int, amount decimal(14,2)",
        "fact_returns": "return_id string, date_key int, return_type string, refund_amount decimal(14,2), cash_refund decimal(14,2), due_adjustment decimal(14,2)",
        "fact_purchases": "purchase_id string, date_key int, line_total decimal(14,2), quantity decimal(14,3)",
        "fact_partner_capital": "capital_transaction_id string, date_key int, transaction_type string, amount decimal(14,2)",
    }
    tables = {n: spark.createDataFrame([], s) for n, s in empty.items()}
    tables["dim_date"] = calendar(spark, dt.date(2026, 1, 1), dt.date(2026, 3, 31))
    tables["dim_product"] = spark.createDataFrame(
        [(k, f"P{k}", f"name {k}", c, "kg") for c, k in products.items()],
        "product_key bigint, product_id string, product_name string, category string, unit string",
    )
    tables["dim_customer"] = spark.createDataFrame([(1, "C1", "Ann")], "customer_key bigint, customer_id string, customer_name string")
    tables["dim_location"] = spark.createDataFrame([(1, "L1", "Shop", "store")], "location_key bigint, stock_location_id string, location_name string, location_type string")
    tables["dim_cash_account"] = spark.createDataFrame([(1, "A1", "Till", "cash", None)], "cash_account_key bigint, cash_account_id string, account_name string, account_type string, owner_id string")
    tables["fact_sales"] = spark.createDataFrame(
        [(f"s{i}", _key(d), 1 if i % 2 else None, products[c], 1, Decimal(a), Decimal(a), Decimal("2.000")) for i, (c, a, d) in enumerate(SALES)],
        "order_item_id string, date_key int, customer_key bigint, product_key bigint, location_key bigint, gross_sales decimal(14,2),"
        " line_total decimal(14,2), quantity decimal(14,3)",
    )
    tables["fact_expenses"] = spark.createDataFrame(
        [(f"e{i}", _key(d), c, Decimal(a), 1) for i, (c, a, d) in enumerate(EXPENSES)],
        "expense_id string, date_key int, expense_category string, amount decimal(14,2), cash_account_key bigint",
    )
    tables["fact_cash_transactions"] = spark.createDataFrame(
        [(f"c{i}", _key(d), x, Decimal(a), 1) for i, (a, x, d) in enumerate(CASH)],
        "transaction_id string, date_key int, direction string, amount decimal(14,2), cash_account_key bigint",
    )
    return tables
