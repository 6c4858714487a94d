"""The eleven business views, composed with only the joins a request needs.

A dimension none of whose columns is asked for is not joined. For an inner
join this relies on facts holding only resolved keys, which the fact loaders
guarantee; ``all_joins`` keeps every join instead. Date limits become limits
on ``date_key`` (and on the month partition), so they reach the scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.calendar import key_day, literal_day_key
from tallyspark.operators.joins import left_join_spread_nulls

Tables = Mapping[str, DataFrame]

FULL_CALENDAR = ("year", "quarter", "month", "month_name", "week", "day", "day_name", "is_weekend")
SHORT_CALENDAR = ("year", "quarter", "month", "month_name")
TENANT = "tenant_id"
LINEAGE = ("source_system", "source_table", "source_row_identifier", "ingestion_batch_id", "ingested_at")


@dataclass(frozen=True)
class Joined:
    """A dimension in one role. ``columns``: view column -> dimension column."""

    table: str
    fact_key: str
    dim_key: str
    how: str
    columns: dict[str, str]


@dataclass(frozen=True)
class ViewSpec:
    name: str
    base: Callable[[Tables], DataFrame]
    date_column: str
    calendar: tuple[str, ...]
    leading: tuple[str, ...]
    dims: tuple[Joined, ...]
    own: tuple[str, ...]
    computed: dict[str, Callable[[], Column]] = field(default_factory=dict)
    inputs: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def columns(self) -> tuple[str, ...]:
        joined = [c for d in self.dims for c in d.columns]
        return (*self.leading, "date_key", self.date_column, *self.calendar, *joined, *self.own, *self.computed, *LINEAGE)


def _fact(table: str) -> Callable[[Tables], DataFrame]:
    return lambda t: t[table]


# view column -> column of the return
RETURN_COLUMNS = {
    "date_key": "date_key", "return_type": "return_type", "order_id": "order_id", "purchase_id": "purchase_id",
    "return_status": "status", "customer_key": "customer_key", "location_key": "location_key",
}


def _return_lines(t: Tables) -> DataFrame:
    """Return lines with the columns of their return, or with the row these are made of later on."""
    returns = t["fact_returns"]
    late = [c for c in returns.columns if c.startswith("__")]
    parent = returns.select("return_id", *[F.col(c).alias(n) for n, c in RETURN_COLUMNS.items() if not late or c in returns.columns], *late)
    # a line lies in the month of its return, so a limit on days prunes its months too
    rows = t["fact_return_items"].join(parent, "return_id")
    return rows.drop("return_id") if late else rows


def _customer(*more: tuple[str, str]) -> Joined:
    columns = {c: c for c in ("customer_key", "customer_id", "customer_name")}
    return Joined("dim_customer", "customer_key", "customer_key", "left", {**columns, **dict(more)})


def _product() -> Joined:
    return Joined(
        "dim_product", "product_key", "product_key", "inner",
        {"product_key": "product_key", "product_id": "product_id", "product_name": "product_name",
         "product_category": "category", "product_unit": "unit"},
    )


def _location(with_type: bool = True) -> Joined:
    columns = {"location_key": "location_key", "location_id": "stock_location_id", "location_name": "location_name"}
    if with_type:
        columns["location_type"] = "location_type"
    return Joined("dim_location", "location_key", "location_key", "inner", columns)


def _moved(role: str) -> Joined:
    return Joined(
        "dim_location", f"{role}_location_key", "location_key", "left",
        {f"{role}_location_key": "location_key", f"{role}_location_id": "stock_location_id",
         f"{role}_location_name": "location_name"},
    )


def _account(how: str, with_owner: bool = False) -> Joined:
    columns = {
        "cash_account_key": "cash_account_key", "cash_account_id": "cash_account_id",
        "cash_account_name": "account_name", "cash_account_type": "account_type",
    }
    if with_owner:
        columns["cash_account_owner_id"] = "owner_id"
    return Joined("dim_cash_account", "cash_account_key", "cash_account_key", how, columns)


VIEWS: dict[str, ViewSpec] = {
    v.name: v
    for v in (
        ViewSpec(
            "v_orders", _fact("fact_orders"), "order_date", FULL_CALENDAR, ("order_key", "order_id"),
            (_customer(("customer_phone", "phone"), ("customer_address", "address"), ("customer_status", "status")),),
            ("subtotal", "invoice_discount", "delivery_charge", "total_amount", "order_status", "collected_by",
             "source_created_at"),
            {"calculated_order_amount": lambda: F.col("subtotal") - F.col("invoice_discount") + F.col("delivery_charge")},
            {"calculated_order_amount": ("subtotal", "invoice_discount", "delivery_charge")},
        ),
        ViewSpec(
            "v_sales", _fact("fact_sales"), "sale_date", FULL_CALENDAR, ("sales_key", "order_item_id", "order_id"),
            (_customer(("customer_phone", "phone"), ("customer_status", "status")), _product(), _location()),
            ("quantity", "unit_price", "item_discount", "line_total", "gross_sales", "unit_cost", "cogs"),
            {"calculated_net_line_amount": lambda: F.col("quantity") * F.col("unit_price") - F.col("item_discount")},
            {"calculated_net_line_amount": ("quantity", "unit_price", "item_discount")},
        ),
        ViewSpec(
            "v_payments", _fact("fact_payments"), "payment_date", SHORT_CALENDAR, ("payment_key", "payment_id"),
            (_customer(), _account("left", with_owner=True)),
            ("order_id", "amount", "payment_method", "collected_by", "notes", "source_created_at"),
        ),
        ViewSpec(
            "v_returns", _fact("fact_returns"), "return_date", SHORT_CALENDAR, ("return_key", "return_id"),
            (_customer(), _location(), _account("inner")),
            ("return_type", "order_id", "purchase_id", "refund_amount", "due_adjustment", "cash_refund", "returned_by",
             "reason", "status", "notes", "source_created_at"),
        ),
        ViewSpec(
            "v_return_items", _return_lines, "return_date", SHORT_CALENDAR,
            ("return_item_key", "return_item_id", "return_id"),
            (_customer(), _product(), _location(with_type=False)),
            ("return_type", "order_id", "purchase_id", "return_status", "quantity", "unit_price", "line_amount",
             "returned_cogs"),
        ),
        ViewSpec(
            "v_purchases", _fact("fact_purchases"), "purchase_date", SHORT_CALENDAR,
            ("purchase_key", "purchase_id", "purchase_item_id"),
            (Joined("dim_supplier", "supplier_key", "supplier_key", "inner",
                    {"supplier_key": "supplier_key", "supplier_id": "supplier_id", "supplier_name": "supplier_name",
                     "supplier_contact": "contact", "supplier_address": "address"}),
             _product(), _location()),
            ("quantity", "unit_cost", "item_discount", "line_total"),
            {"gross_purchase_amount": lambda: F.col("quantity") * F.col("unit_cost"),
             "calculated_net_purchase_amount": lambda: F.col("quantity") * F.col("unit_cost") - F.col("item_discount")},
            {"gross_purchase_amount": ("quantity", "unit_cost"),
             "calculated_net_purchase_amount": ("quantity", "unit_cost", "item_discount")},
        ),
        ViewSpec(
            "v_cash_transactions", _fact("fact_cash_transactions"), "transaction_date", SHORT_CALENDAR,
            ("cash_transaction_key", "transaction_id"), (_account("inner", with_owner=True),),
            ("transaction_type", "direction", "amount", "reference_type", "reference_id", "description", "created_by",
             "source_created_at"),
        ),
        ViewSpec(
            "v_expenses", _fact("fact_expenses"), "expense_date", SHORT_CALENDAR, ("expense_key", "expense_id"),
            (_account("left"),),
            ("expense_category", "amount", "payment_method", "description", "reference", "paid_by", "created_by",
             "created_at"),
        ),
        ViewSpec(
            "v_partner_capital", _fact("fact_partner_capital"), "transaction_date", SHORT_CALENDAR,
            ("capital_key", "capital_transaction_id"),
            (Joined("dim_partner", "partner_key", "partner_key", "inner",
                    {c: c for c in ("partner_key", "partner_id", "partner_name")}),
             _account("inner")),
            ("transaction_type", "amount", "reference_id", "notes", "created_by", "created_at"),
        ),
        ViewSpec(
            "v_stock_movements", _fact("fact_stock_movements"), "movement_date", SHORT_CALENDAR,
            ("stock_movement_key", "movement_id"), (_product(), _moved("from"), _moved("to")),
            ("movement_type", "direction", "quantity", "reference_id", "notes"),
        ),
    )
}

SUMMARY = "v_daily_business_summary"


def limit_days(facts: DataFrame, start: dt.date | None, end: dt.date | None) -> DataFrame:
    """Keep days from ``start`` to ``end``, both included, by the integer day key."""
    for bound, low in ((start, True), (end, False)):
        if bound is None:
            continue
        key = literal_day_key(bound)
        facts = facts.where(F.col("date_key") >= key if low else F.col("date_key") <= key)
        if "load_month" in facts.columns:
            month = key // 100
            facts = facts.where(F.col("load_month") >= month if low else F.col("load_month") <= month)
    return facts


def compose_view(
    tables: Tables,
    name: str,
    columns: Sequence[str] | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
    all_joins: bool = False,
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Rows of a view; ``columns`` limits output and joins to what is needed.

    ``finish`` is for facts that come with the row they are made of: it works out their own columns after the joins.
    """
    if name == SUMMARY:
        from tallyspark.plans.summary import daily_business_summary

        summary = daily_business_summary(tables, start, end, columns)
        return summary if columns is None else summary.select(*columns)
    spec = VIEWS[name]
    wanted = list(spec.columns if columns is None else columns)
    unknown = [c for c in wanted if c not in spec.columns and not (c == TENANT and has_tenant(tables, name))]
    if unknown:
        raise ValueError(f"{name} has no column {unknown}")

    rows = limit_days(spec.base(tables), start, end)
    for dim in spec.dims:
        needed = [c for c in dim.columns if c in wanted]
        only_key = needed == [c for c in needed if dim.columns[c] == dim.dim_key]
        if only_key and not (all_joins and dim.how == "inner"):
            # the fact's own key is the dimension's key
            rows = rows.select("*", *[F.col(dim.fact_key).alias(c) for c in needed if c != dim.fact_key])
            continue
        key = f"__{dim.fact_key}"
        side = tables[dim.table].select(
            F.col(dim.dim_key).alias(key), *[F.col(dim.columns[c]).alias(c) for c in needed if c != dim.fact_key]
        )
        if dim.how == "left":
            row_id = spec.leading[1] if spec.leading[1] in rows.columns else spec.leading[0]
            rows = left_join_spread_nulls(rows, side, dim.fact_key, key, row_id).drop(key)
        else:
            rows = rows.join(side, rows[dim.fact_key] == side[key], dim.how).drop(key)
    asked_parts = [c for c in spec.calendar if c in wanted]
    if asked_parts or all_joins:
        days = tables["dim_date"].select("date_key", F.col("date").alias(spec.date_column), *asked_parts)
        rows = rows.join(F.broadcast(days), "date_key")  # a row per day of the calendar, however many facts
    elif spec.date_column in wanted:
        rows = rows.withColumn(spec.date_column, key_day(F.col("date_key")))
    if finish is not None:
        rows = finish(rows)
    for column, build in spec.computed.items():
        if column in wanted:
            rows = rows.withColumn(column, build())
    return rows.select(*wanted)


def has_tenant(tables: Tables, name: str) -> bool:
    """Whether the rows behind a view say whose they are. The summary adds up all of them and does not."""
    return name != SUMMARY and TENANT in VIEWS[name].base(tables).columns


def for_tenant(view: DataFrame, tenant_id: str) -> DataFrame:
    """A view whose first column says whose rows they are."""
    return view.select(F.lit(tenant_id).alias("tenant_id"), "*")


def register_views(tables: Tables, tenant_id: str | None = None) -> list[str]:
    """Create temp views for SQL users; returns their names."""
    names = [*VIEWS, SUMMARY]
    for name in names:
        view = compose_view(tables, name)
        (view if tenant_id is None else for_tenant(view, tenant_id)).createOrReplaceTempView(name)
    return names
