"""Rows of the seven dimensions from staged master data."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.calendar import calendar_parts, day_key
from tallyspark.operators.latest import VERSION_COLUMNS, pending_latest
from tallyspark.operators.upsert import upsert

# The calendar loaded when no range is given.
CALENDAR_START = dt.date(2026, 8, 1)
CALENDAR_END = dt.date(2035, 12, 31)


@dataclass(frozen=True)
class DimensionSpec:
    """``columns`` maps dimension columns to staging columns."""

    table: str
    staging: str
    business_key: str
    key_column: str
    columns: dict[str, str]
    text_columns: tuple[str, ...] = field(default=())
    versioned: bool = False
    current_column: str = "active"


DIMENSIONS: dict[str, DimensionSpec] = {
    d.table: d
    for d in (
        DimensionSpec(
            "dim_customer", "customer", "customer_id", "customer_key",
            {"customer_id": "customer_id", "customer_name": "customer_name", "phone": "contact",
             "address": "address", "status": "status"},
            versioned=True, current_column="is_current",
        ),
        DimensionSpec(
            "dim_product", "product", "product_id", "product_key",
            {"product_id": "product_id", "product_name": "product_name", "category": "category", "unit": "unit",
             "current_selling_price": "selling_price", "current_cost_price": "cost_price",
             "opening_stock": "opening_stock", "reorder_level": "reorder_level", "active": "active"},
            text_columns=("active",), versioned=True, current_column="is_current",
        ),
        DimensionSpec(
            "dim_supplier", "supplier", "supplier_id", "supplier_key",
            {c: c for c in ("supplier_id", "supplier_name", "contact", "address", "active")},
        ),
        DimensionSpec(
            "dim_partner", "partner", "partner_id", "partner_key",
            {c: c for c in ("partner_id", "partner_name", "active")},
        ),
        DimensionSpec(
            "dim_cash_account", "cash_account", "cash_account_id", "cash_account_key",
            {c: c for c in ("cash_account_id", "account_name", "account_type", "owner_id", "active")},
        ),
        DimensionSpec(
            "dim_location", "stock_location", "stock_location_id", "location_key",
            {"stock_location_id": "stock_location_id", "location_name": "location_name",
             "location_type": "location_type", "partner_key": "partner_key", "active": "active"},
        ),
    )
}


def calendar(spark: SparkSession, start: dt.date = CALENDAR_START, end: dt.date = CALENDAR_END) -> DataFrame:
    """One row per day, both ends included."""
    if start > end:
        raise ValueError("start cannot be later than end")
    days = (end - start).days + 1
    day = F.date_add(F.lit(start), F.col("id").cast("int"))
    return (
        spark.range(0, days, 1, 1)
        .select(day.alias("date"))
        .select(day_key(F.col("date")).alias("date_key"), "date", *[c.alias(n) for n, c in calendar_parts(F.col("date")).items()])
    )


def extend_calendar(existing: DataFrame | None, wanted: DataFrame) -> DataFrame:
    """Calendar with the missing days added."""
    if existing is None:
        return wanted
    return existing.unionByName(wanted.join(existing.select("date"), "date", "left_anti").select(*existing.columns))


def incoming_rows(
    spec: DimensionSpec,
    staged: DataFrame,
    partners: DataFrame | None = None,
    version: Sequence[str | Column] = VERSION_COLUMNS,
) -> DataFrame:
    """Latest accepted version per business key, under the dimension's column names."""
    rows = pending_latest(staged, [spec.business_key], version)
    if spec.table == "dim_location":
        if partners is None:
            raise ValueError("dim_location needs dim_partner")
        # a location whose partner is unknown keeps a NULL partner
        rows = rows.join(partners.select("partner_id", "partner_key"), "partner_id", "left")
    named = [
        (F.col(source).cast("string") if name in spec.text_columns else F.col(source)).alias(name)
        for name, source in spec.columns.items()
    ]
    rows = rows.select(*named)
    if spec.versioned:
        rows = rows.withColumn("valid_to", F.lit(None).cast("timestamp")).withColumn("is_current", F.lit(True))
    return rows


def load_dimension(
    table: str,
    staged: DataFrame,
    existing: DataFrame | None = None,
    partners: DataFrame | None = None,
    loaded_at: Column | None = None,
    version: Sequence[str | Column] = VERSION_COLUMNS,
) -> DataFrame:
    """Content of a dimension after upserting the staged rows."""
    return upsert_dimension(table, incoming_rows(DIMENSIONS[table], staged, partners, version), existing, loaded_at)


def upsert_dimension(
    table: str, incoming: DataFrame, existing: DataFrame | None = None, loaded_at: Column | None = None
) -> DataFrame:
    """Content of a dimension after upserting rows that already have its columns."""
    spec = DIMENSIONS[table]
    first_seen = {"valid_from": loaded_at if loaded_at is not None else F.current_timestamp()} if spec.versioned else None
    return upsert(existing, incoming, [spec.business_key], spec.key_column, first_seen)
