"""Rows of the ten facts: latest staged version, dimension keys, defaults.

Each loader returns the rows to upsert; ``FACTS`` says on which key. A staged
row without its mandatory dimension is left out by the inner join;
``unresolved_rows`` lists such rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.cleaning import MONEY, QUANTITY
from tallyspark.functions.measures import gross_line, money, net_line, or_word, or_zero, safe_ratio
from tallyspark.operators.joins import left_join_spread_nulls
from tallyspark.operators.latest import VERSION_COLUMNS, pending_latest

Tables = Mapping[str, DataFrame]
Version = Sequence[str | Column]

LINEAGE = ("source_system", "source_table", "source_row_identifier", "ingestion_batch_id", "ingested_at")


@dataclass(frozen=True)
class FactSpec:
    table: str
    key_column: str
    business_key: tuple[str, ...]
    staging: str
    staging_key: str
    load: Callable[..., DataFrame]
    # the two steps of ``load`` for facts whose own columns can be worked out after further joins, and what the joins give
    joined: Callable[[Tables, DataFrame], DataFrame] | None = None
    own_columns: Callable[[], dict[str, Column]] | None = None
    joined_columns: tuple[str, ...] = ()


def latest_staged(t: Tables, staging: str, keys: Sequence[str], version: Version) -> DataFrame:
    """The latest accepted version per key. Tables that are derived may bring these rows themselves, as ``latest_…``."""
    own = f"latest_{staging}"
    return t[own] if own in t else pending_latest(t[staging], keys, version)


def _dates(t: Tables) -> DataFrame:
    return t["dim_date"].select("date_key", "date")


def _with_date(rows: DataFrame, t: Tables, day: str) -> DataFrame:
    return rows.join(_dates(t).withColumnRenamed("date", day), day, "inner")


def _current_customers(t: Tables) -> DataFrame:
    current = t["dim_customer"].where(F.col("is_current"))
    return current.select(F.col("customer_id").alias("__customer_id"), "customer_key")


def _accounts(t: Tables, only_active: bool = False) -> DataFrame:
    accounts = t["dim_cash_account"]
    if only_active:
        accounts = accounts.where(F.col("active"))
    return accounts.select(F.col("cash_account_id").alias("__account_id"), "cash_account_key")


def _locations(t: Tables, only_active: bool = False, prefix: str = "") -> DataFrame:
    places = t["dim_location"]
    if only_active:
        places = places.where(F.col("active"))
    return places.select(
        F.col("stock_location_id").alias(f"__{prefix}location_id"), F.col("location_key").alias(f"{prefix}location_key")
    )


def _products(t: Tables, *more: str, only_current: bool = False) -> DataFrame:
    products = t["dim_product"]
    if only_current:
        products = products.where(F.col("is_current"))
    return products.select(F.col("product_id").alias("__product_id"), "product_key", *more)


def load_orders(t: Tables, version: Version = VERSION_COLUMNS) -> DataFrame:
    rows = _with_date(latest_staged(t, "stg_order", ["order_id"], version), t, "order_date")
    rows = left_join_spread_nulls(rows, _current_customers(t), "customer_id", "__customer_id", "order_id")
    return rows.select(
        "order_id",
        "date_key",
        "customer_key",
        or_zero("subtotal").cast(MONEY).alias("subtotal"),
        or_zero("discount").cast(MONEY).alias("invoice_discount"),
        or_zero("delivery_charge").cast(MONEY).alias("delivery_charge"),
        or_zero("total_amount").cast(MONEY).alias("total_amount"),
        or_word("order_status", "unknown").alias("order_status"),
        "collected_by",
        "source_created_at",
        *LINEAGE,
    )


SALES_KEYS = ("date_key", "customer_key", "product_key", "location_key")


def joined_sales(t: Tables, items: DataFrame) -> DataFrame:
    """Sold lines with their keys; whatever else ``items`` brings stays."""
    orders = t["fact_orders"].select("order_id", "date_key", "customer_key")
    return (
        items.join(_products(t), F.col("product_id") == F.col("__product_id"))
        .join(_locations(t), F.col("stock_location_id") == F.col("__location_id"))
        .join(orders, "order_id")
    )


def own_of_sales() -> dict[str, Column]:
    """The columns of a sale that are made of its staged line alone."""
    quantity, price, discount = F.col("quantity"), or_zero("unit_price"), or_zero("item_discount")
    cost = or_zero("cost_price")
    return {
        "order_id": F.col("order_id"),
        "order_item_id": F.col("order_item_id"),
        "quantity": quantity.cast(QUANTITY),
        "unit_price": money(price),
        "item_discount": money(discount),
        "line_total": money(F.coalesce("line_amount", net_line(quantity, price, discount))),
        "gross_sales": gross_line(quantity, price),
        "unit_cost": money(cost),
        "cogs": money(F.coalesce("cogs", gross_line(quantity, cost))),
        **{c: F.col(c) for c in LINEAGE},
    }


def load_sales(t: Tables, version: Version = VERSION_COLUMNS) -> DataFrame:
    own = own_of_sales()
    # worked out before the joins: readers of few columns have less shuffled than the staged columns these are made of
    items = latest_staged(t, "stg_order_item", ["order_item_id"], version).select(
        "product_id", "stock_location_id", *[c.alias(n) for n, c in own.items()]
    )
    order, line, *measures = own
    return joined_sales(t, items).select(order, line, *SALES_KEYS, *measures)


def load_payments(t: Tables, version: Version = VERSION_COLUMNS) -> DataFrame:
    rows = _with_date(latest_staged(t, "stg_payment", ["payment_id"], version), t, "payment_date")
    rows = left_join_spread_nulls(rows, _current_customers(t), "customer_id", "__customer_id", "payment_id")
    rows = left_join_spread_nulls(rows, _accounts(t), "cash_account_id", "__account_id", "payment_id")
    return rows.select(
        "payment_id",
        "date_key",
        "order_id",
        "customer_key",
        "cash_account_key",
        money(F.col("amount")).alias("amount"),
        or_word("payment_method", "unknown").alias("payment_method"),
        "collected_by",
        "notes",
        "source_created_at",
        *LINEAGE,
    )


RETURN_KEYS = ("date_key", "customer_key", "location_key", "cash_account_key")


def joined_returns(t: Tables, returns: DataFrame) -> DataFrame:
    """Returns with their keys; whatever else ``returns`` brings stays."""
    rows = (
        _with_date(returns, t, "return_date")
        .join(_locations(t, only_active=True), F.col("location_id") == F.col("__location_id"))
        .join(_accounts(t, only_active=True), F.col("cash_account_id") == F.col("__account_id"))
    )
    return left_join_spread_nulls(rows, _current_customers(t), "customer_id", "__customer_id", "return_id")


def own_of_returns() -> dict[str, Column]:
    """The columns of a return that are made of its staged row alone."""
    refund, adjustment = or_zero("refund_amount"), or_zero("adjustment_amount")
    return {
        "return_id": F.col("return_id"),
        "return_type": F.upper("return_type"),
        "order_id": F.col("order_id"),
        "purchase_id": F.col("purchase_id"),
        "refund_amount": money(refund),
        "due_adjustment": money(adjustment),
        "cash_refund": money(F.greatest(refund - adjustment, F.lit(0))),
        "returned_by": F.col("returned_by"),
        "reason": F.col("reason"),
        "status": or_word("return_status", "unknown"),
        "notes": F.col("notes"),
        "source_created_at": F.col("source_created_at"),
        **{c: F.col(c) for c in LINEAGE},
    }


def load_returns(t: Tables, version: Version = VERSION_COLUMNS) -> DataFrame:
    rows = joined_returns(t, latest_staged(t, "stg_return", ["return_id"], version))
    own = [c.alias(n) for n, c in own_of_returns().items()]
    return rows.select(own[0], "date_key", *own[1:4], *RETURN_KEYS[1:], *own[4:])


def joined_return_items(t: Tables, items: DataFrame) -> DataFrame:
    """Return lines with the key of their product and their returned cost; whatever else ``items`` brings stays."""
    sold = t["fact_sales"].select(
        F.col("order_item_id").alias("__sold_item"), F.col("quantity").alias("__sold"), F.col("cogs").alias("__cogs")
    )
    rows = items.join(t["fact_returns"].select("return_id"), "return_id").join(
        _products(t, "current_cost_price"), F.col("product_id") == F.col("__product_id")
    )
    rows = left_join_spread_nulls(rows, sold, "order_item_id", "__sold_item", "return_item_id")
    quantity = F.col("quantity")
    cogs = F.coalesce(
        quantity * safe_ratio(F.col("__cogs"), F.col("__sold")), quantity * F.col("current_cost_price"), F.lit(0)
    )
    return rows.withColumn("returned_cogs", money(cogs))


def own_of_return_items() -> dict[str, Column]:
    """The columns of a return line that are made of its staged row alone."""
    quantity, price = F.col("quantity"), or_zero("unit_price")
    return {
        "return_item_id": F.col("return_item_id"),
        "return_id": F.col("return_id"),
        "quantity": quantity.cast(QUANTITY),
        "unit_price": money(price),
        "line_amount": money(F.coalesce("amount", quantity * price)),
        **{c: F.col(c) for c in LINEAGE},
    }


def load_return_items(t: Tables, version: Version = VERSION_COLUMNS) -> DataFrame:
    rows = joined_return_items(t, latest_staged(t, "stg_return_item", ["return_item_id"], version))
    own = [c.alias(n) for n, c in own_of_return_items().items()]
    return rows.select(*own[:2], "product_key", *own[2:5], "returned_cogs", *own[5:])


def load_purchases(t: Tables, version: Version = VERSION_COLUMNS, header_version: Version | None = None) -> DataFrame:
    headers = latest_staged(t, "stg_purchase", ["purchase_id"], header_version or version)
    suppliers = t["dim_supplier"].where(F.col("active")).select(F.col("supplier_id").alias("__supplier_id"), "supplier_key")
    headers = (
        _with_date(headers, t, "purchase_date")
        .join(suppliers, F.col("supplier_id") == F.col("__supplier_id"))
        .select("purchase_id", "date_key", "supplier_key")
    )
    rows = (
        latest_staged(t, "stg_purchase_item", ["purchase_item_id"], version)
        .join(_products(t, only_current=True), F.col("product_id") == F.col("__product_id"))
        .join(_locations(t, only_active=True), F.col("stock_location_id") == F.col("__location_id"))
        .join(headers, "purchase_id")
    )
    return rows.select(
        "purchase_id",
        "purchase_item_id",
        "date_key",
        "supplier_key",
        "product_key",
        "location_key",
        F.col("quantity").cast(QUANTITY).alias("quantity"),
        or_zero("unit_cost").cast(MONEY).alias("unit_cost"),
        or_zero("item_discount").cast(MONEY).alias("item_discount"),
        or_zero("line_amount").cast(MONEY).alias("line_total"),
        *LINEAGE,
    )


def load_cash_transactions(t: Tables, version: Version = VERSION_COLUMNS) -> DataFrame:
    rows = _with_date(latest_staged(t, "stg_cash_transaction", ["transaction_id"], version), t, "transaction_date")
    rows = rows.join(_accounts(t), F.col("cash_account_id") == F.col("__account_id"))
    return rows.select(
        "transaction_id",
        "date_key",
        "cash_account_key",
        "transaction_type",
        "direction",
        money(F.col("amount")).alias("amount"),
        "reference_type",
        "reference_id",
        F.coalesce("description", "notes").alias("description"),
        "created_by",
        "source_created_at",
        *LINEAGE,
    )


def load_expenses(t: Tables, version: Version = VERSION_COLUMNS) -> DataFrame:
    rows = _with_date(latest_staged(t, "stg_expense", ["expense_id"], version), t, "expense_date")
    rows = left_join_spread_nulls(rows, _accounts(t), "cash_account_id", "__account_id", "expense_id")
    return rows.select(
        "expense_id",
        "date_key",
        or_word("expense_category", "uncategorized").alias("expense_category"),
        "description",
        money(F.col("amount")).alias("amount"),
        or_word("payment_method", "unknown").alias("payment_method"),
        "cash_account_key",
        "paid_by",
        F.col("reference_id").alias("reference"),
        "created_by",
        F.col("source_created_at").alias("created_at"),
        *LINEAGE,
    )


def load_partner_capital(t: Tables, version: Version = VERSION_COLUMNS) -> DataFrame:
    rows = _with_date(
        latest_staged(t, "stg_partner_capital", ["partner_capital_entry_id"], version), t, "entry_date"
    )
    partners = t["dim_partner"].select(F.col("partner_id").alias("__partner_id"), "partner_key")
    rows = rows.join(partners, F.col("partner_id") == F.col("__partner_id")).join(
        _accounts(t), F.col("cash_account_id") == F.col("__account_id")
    )
    return rows.select(
        "capital_transaction_id",
        "date_key",
        "partner_key",
        "cash_account_key",
        "transaction_type",
        money(F.col("amount")).alias("amount"),
        "reference_id",
        "notes",
        "created_by",
        F.col("source_created_at").alias("created_at"),
        *LINEAGE,
    )


def load_stock_movements(t: Tables, version: Version = VERSION_COLUMNS) -> DataFrame:
    rows = _with_date(latest_staged(t, "stg_stock_movement", ["movement_id"], version), t, "movement_date")
    rows = rows.join(_products(t), F.col("product_id") == F.col("__product_id"))
    rows = left_join_spread_nulls(rows, _locations(t, prefix="from_"), "from_location_id", "__from_location_id", "movement_id")
    rows = left_join_spread_nulls(rows, _locations(t, prefix="to_"), "to_location_id", "__to_location_id", "movement_id")
    return rows.select(
        "movement_id",
        "date_key",
        "product_key",
        "movement_type",
        "direction",
        F.col("quantity").cast(QUANTITY).alias("quantity"),
        "from_location_key",
        "to_location_key",
        "reference_id",
        "notes",
        *LINEAGE,
    )


# in load order: sales and return items read facts loaded before them
FACTS: dict[str, FactSpec] = {
    f.table: f
    for f in (
        FactSpec("fact_orders", "order_key", ("order_id",), "stg_order", "order_id", load_orders),
        FactSpec(
            "fact_sales", "sales_key", ("order_item_id",), "stg_order_item", "order_item_id", load_sales,
            joined_sales, own_of_sales, SALES_KEYS,
        ),
        FactSpec("fact_payments", "payment_key", ("payment_id",), "stg_payment", "payment_id", load_payments),
        FactSpec(
            "fact_returns", "return_key", ("return_id",), "stg_return", "return_id", load_returns,
            joined_returns, own_of_returns, RETURN_KEYS,
        ),
        FactSpec(
            "fact_return_items", "return_item_key", ("return_item_id",), "stg_return_item", "return_item_id",
            load_return_items, joined_return_items, own_of_return_items, ("product_key", "returned_cogs"),
        ),
        FactSpec(
            "fact_purchases", "purchase_key", ("purchase_id", "purchase_item_id"), "stg_purchase_item",
            "purchase_item_id", load_purchases,
        ),
        FactSpec(
            "fact_cash_transactions", "cash_transaction_key", ("transaction_id",), "stg_cash_transaction",
            "transaction_id", load_cash_transactions,
        ),
        FactSpec("fact_expenses", "expense_key", ("expense_id",), "stg_expense", "expense_id", load_expenses),
        FactSpec(
            "fact_partner_capital", "capital_key", ("capital_transaction_id",), "stg_partner_capital",
            "partner_capital_entry_id", load_partner_capital,
        ),
        FactSpec(
            "fact_stock_movements", "stock_movement_key", ("movement_id",), "stg_stock_movement", "movement_id",
            load_stock_movements,
        ),
    )
}


def unresolved_rows(fact: str, t: Tables) -> DataFrame:
    """Accepted staged keys that a mandatory join kept out of the fact."""
    spec = FACTS[fact]
    key = spec.business_key[-1]
    staged_key = "capital_transaction_id" if fact == "fact_partner_capital" else spec.staging_key
    staged = t[spec.staging].where(F.col("record_status") == "pending").select(F.col(staged_key).alias(key)).distinct()
    return staged.join(t[fact].select(key), key, "left_anti")
