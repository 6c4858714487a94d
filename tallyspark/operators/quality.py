"""Data-quality checks as report rows.

A check adds columns to one aggregate of its table; all such checks of a table
share one scan. The report is a DataFrame with a row per check.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPORT_SCHEMA = "check_name string, status string, severity string, affected_rows bigint, message string"


def _verdict(name: str, failed: Column, affected: Column, status: str, severity: str, message: Column) -> Column:
    """One report row as a struct."""
    return F.struct(
        F.lit(name).alias("check_name"),
        F.when(failed, F.lit(status)).otherwise(F.lit("PASS")).alias("status"),
        F.when(failed, F.lit(severity)).otherwise(F.lit("INFO")).alias("severity"),
        F.when(failed, affected).otherwise(F.lit(0)).cast("bigint").alias("affected_rows"),
        F.when(failed, message).otherwise(F.lit("")).alias("message"),
    )


@dataclass(frozen=True)
class TableCheck:
    """A check that needs only aggregates of its own table."""

    name: str
    measures: dict[str, Column]
    judge: object = field(repr=False)  # measures by name -> report struct


def null_rate(table: str, column: str, threshold: float = 0.0) -> TableCheck:
    """NULL share in percent against a threshold; an empty table passes."""
    name = f"null_rate:{table}.{column}"

    def judge(m: Mapping[str, Column]) -> Column:
        rate = m["nulls"] * 100.0 / F.nullif(m["rows"], F.lit(0))
        text = F.format_string(f"{table}.{column}: %.2f%% NULL, allowed {threshold:.2f}%%", rate)
        return _verdict(name, F.coalesce(rate > threshold, F.lit(False)), m["nulls"], "WARNING", "WARNING", text)

    return TableCheck(name, {"nulls": F.count_if(F.col(column).isNull()), "rows": F.count("*")}, judge)


def not_null(table: str, column: str, value: Column | None = None) -> TableCheck:
    """A column that must have no NULL; ``value`` states it where the rows at hand hold it under another form."""
    name = f"nullability:{table}.{column}"

    def judge(m: Mapping[str, Column]) -> Column:
        text = F.concat(m["nulls"].cast("string"), F.lit(f" NULL values in {table}.{column}"))
        return _verdict(name, m["nulls"] > 0, m["nulls"], "FAIL", "ERROR", text)

    value = F.col(column) if value is None else value
    return TableCheck(name, {"nulls": F.count_if(value.isNull())}, judge)


def freshness(table: str, column: str, max_age_hours: float, now: Column | None = None) -> TableCheck:
    """Age of the newest timestamp; no timestamp at all is a warning too."""
    name = f"freshness:{table}"
    now = F.current_timestamp() if now is None else now

    def judge(m: Mapping[str, Column]) -> Column:
        age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(m["latest"].cast("timestamp"))) / 3.6e9
        stale = F.coalesce(age > max_age_hours, F.lit(True))
        text = F.concat(F.lit(f"{table}: newest {column} is "), F.coalesce(m["latest"].cast("string"), F.lit("missing")))
        return _verdict(name, stale, F.lit(1), "WARNING", "WARNING", text)

    return TableCheck(name, {"latest": F.max(column)}, judge)


def line_amount(
    table: str, quantity: str, price: str, total: str, tolerance: str = "0.01", discount: str | None = None
) -> TableCheck:
    """Lines whose total is not quantity times price (less ``discount``, when given)."""
    name = f"sales_amount_rule:{table}"
    expected = F.col(quantity) * F.col(price)
    if discount is not None:
        expected = expected - F.coalesce(F.col(discount), F.lit(0))
    off = F.abs(expected - F.col(total)) > F.lit(tolerance).cast("decimal(10,4)")

    def judge(m: Mapping[str, Column]) -> Column:
        text = F.concat(m["off"].cast("string"), F.lit(f" lines of {table} do not add up"))
        return _verdict(name, m["off"] > 0, m["off"], "FAIL", "ERROR", text)

    return TableCheck(name, {"off": F.count_if(off)}, judge)


def value_range(table: str, column: str, low: float, high: float) -> TableCheck:
    """Values outside [low, high]."""
    name = f"anomaly_threshold:{table}.{column}"

    def judge(m: Mapping[str, Column]) -> Column:
        text = F.concat(m["outside"].cast("string"), F.lit(f" values of {table}.{column} outside [{low}, {high}]"))
        return _verdict(name, m["outside"] > 0, m["outside"], "WARNING", "WARNING", text)

    return TableCheck(name, {"outside": F.count_if(~F.col(column).between(low, high))}, judge)


def run_table_checks(df: DataFrame, checks: Sequence[TableCheck]) -> DataFrame:
    """All checks of a table in one aggregate, one report row each."""
    measures = [c.alias(f"m{i}_{n}") for i, check in enumerate(checks) for n, c in check.measures.items()]
    rows = [
        check.judge({n: F.col(f"m{i}_{n}") for n in check.measures}) for i, check in enumerate(checks)
    ]
    return df.agg(*measures).select(F.inline(F.array(*rows)))


def duplicate_check(df: DataFrame, table: str, column: str, expected_unique: bool = True) -> DataFrame:
    """Number of values an identifier column holds more than once."""
    repeated = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")
    counted = repeated.agg(F.count("*").alias("n"))
    status, severity = ("FAIL", "ERROR") if expected_unique else ("WARNING", "WARNING")
    text = F.concat(F.col("n").cast("string"), F.lit(f" repeated values in {table}.{column}"))
    row = _verdict(f"duplicate_count:{table}.{column}", F.col("n") > 0, F.col("n"), status, severity, text)
    return counted.select(F.inline(F.array(row)))


def orphan_rows(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key is set but has no parent."""
    keys = parent.select(F.col(parent_key).alias("__parent")).where(F.col("__parent").isNotNull())
    return child.where(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("__parent"), "left_anti")


def orphan_check(
    child: DataFrame, child_name: str, child_key: str, parent: DataFrame, parent_name: str, parent_key: str
) -> DataFrame:
    # counted per key first: a key that many rows share crosses the shuffle once
    per_key = child.groupBy(child_key).agg(F.count("*").alias("rows"))
    counted = orphan_rows(per_key, child_key, parent, parent_key).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))
    text = F.concat(F.col("n").cast("string"), F.lit(f" rows of {child_name} without {parent_name}"))
    row = _verdict(f"orphan_check:{child_name}->{parent_name}", F.col("n") > 0, F.col("n"), "FAIL", "ERROR", text)
    return counted.select(F.inline(F.array(row)))


# structure checks read schemas only ------------------------------------------


def _static(spark: SparkSession, name: str, affected: int, message: str) -> DataFrame:
    status, severity = ("PASS", "INFO") if affected == 0 else ("FAIL", "ERROR")
    return spark.createDataFrame([(name, status, severity, affected, message if affected else "")], REPORT_SCHEMA)


def table_exists(spark: SparkSession, tables: Mapping[str, DataFrame] | None, name: str) -> DataFrame:
    """A table of the warehouse, or of the session catalog when no tables are given."""
    found = spark.catalog.tableExists(name) if tables is None else name in tables
    return _static(spark, f"table_exists:{name}", 0 if found else 1, f"{name} does not exist")


def view_exists(spark: SparkSession, name: str) -> DataFrame:
    """A view registered in the session catalog."""
    found = spark.catalog.tableExists(name)
    return _static(spark, f"view_exists:{name}", 0 if found else 1, f"{name} does not exist")


def columns_exist(df: DataFrame, table: str, required: Sequence[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    return _static(df.sparkSession, f"required_columns:{table}", len(missing), f"{table} lacks {missing}")


def column_types(df: DataFrame, table: str, expected: Mapping[str, str]) -> DataFrame:
    """Columns whose type differs from the expected Spark type; a missing column differs."""
    actual = dict(df.dtypes)
    wrong = [f"{c} is {actual.get(c)}, not {t}" for c, t in expected.items() if actual.get(c) != _plain_type(t)]
    return _static(df.sparkSession, f"column_types:{table}", len(wrong), f"{table}: {wrong}")


def _plain_type(name: str) -> str:
    return T.DataType.fromDDL(name).simpleString()


def stack_reports(reports: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), reports)


def report_status(report: DataFrame) -> DataFrame:
    """Overall status and counts: FAIL beats WARNING beats PASS."""
    counts = {s: F.count_if(F.col("status") == s) for s in ("PASS", "WARNING", "FAIL")}
    return report.agg(
        F.when(counts["FAIL"] > 0, "FAIL").when(counts["WARNING"] > 0, "WARNING").otherwise("PASS").alias("status"),
        F.count("*").alias("total_count"),
        *[c.alias(f"{s.lower()}_count") for s, c in counts.items()],
    )


# Spark types and required columns of the core tables.
_LINEAGE = "source_system string, source_table string, source_row_identifier string, ingestion_batch_id string, ingested_at timestamp"
CORE_TYPES = {
    "dim_date": "date_key int, date date, year smallint, quarter smallint, month smallint, month_number smallint,"
    " month_name string, week smallint, day smallint, day_name string, is_weekend boolean",
    "dim_customer": "customer_key bigint, customer_id string, customer_name string, phone string, address string,"
    " status string, valid_from timestamp, valid_to timestamp, is_current boolean",
    "dim_product": "product_key bigint, product_id string, product_name string, category string, unit string,"
    " current_selling_price decimal(14,2), current_cost_price decimal(14,2), opening_stock decimal(14,3),"
    " reorder_level decimal(14,3), active string, valid_from timestamp, valid_to timestamp, is_current boolean",
    "fact_orders": "order_key bigint, order_id string, date_key int, customer_key bigint, subtotal decimal(14,2),"
    " invoice_discount decimal(14,2), delivery_charge decimal(14,2), total_amount decimal(14,2), order_status string,"
    " collected_by string, source_created_at timestamp, " + _LINEAGE,
    "fact_sales": "sales_key bigint, order_id string, order_item_id string, date_key int, customer_key bigint, product_key bigint,"
    " location_key bigint, quantity decimal(14,3), unit_price decimal(14,2), item_discount decimal(14,2),"
    " line_total decimal(14,2), gross_sales decimal(14,2), unit_cost decimal(14,2), cogs decimal(14,2), " + _LINEAGE,
}
CORE_NOT_NULL = {
    "dim_date": (
        "date_key", "date", "year", "quarter", "month", "month_number", "month_name", "week", "day", "day_name", "is_weekend",
    ),
    "dim_customer": ("customer_key", "customer_id", "customer_name", "valid_from", "is_current"),
    "dim_product": ("product_key", "product_id", "product_name", "valid_from", "is_current"),
    "fact_orders": (
        "order_key", "order_id", "date_key", "subtotal", "invoice_discount", "delivery_charge", "total_amount", "order_status",
        "source_system", "source_table", "ingestion_batch_id", "ingested_at",
    ),
    "fact_sales": (
        "sales_key", "order_id", "order_item_id", "date_key", "product_key", "location_key", "quantity", "unit_price",
        "item_discount", "line_total", "gross_sales", "unit_cost", "cogs", "source_system", "source_table", "ingestion_batch_id",
        "ingested_at",
    ),
}
CORE_VIEWS = ("v_orders", "v_sales", "v_payments", "v_returns", "v_purchases", "v_daily_business_summary")
CORE_TABLES = (
    "dim_date", "dim_customer", "dim_product", "dim_supplier", "dim_partner", "dim_location", "dim_cash_account",
    "fact_orders", "fact_sales", "fact_payments", "fact_purchases", "fact_returns", "fact_return_items",
    "fact_stock_movements", "fact_cash_transactions", "fact_expenses", "fact_partner_capital",
)


def warehouse_structure(
    spark: SparkSession, tables: Mapping[str, DataFrame], verify_nulls: bool = True,
    also: Mapping[str, Sequence[TableCheck]] | None = None,
) -> DataFrame:
    """Existence, types and required columns of the core tables, and the views in the session catalog.

    Parquet marks every column nullable, so required columns are verified on
    the data: one scan per table, only of the columns concerned. ``also``
    holds more checks of core tables, which join that scan.
    """
    also = also or {}
    reports = [table_exists(spark, tables, t) for t in CORE_TABLES]
    reports += [view_exists(spark, v) for v in CORE_VIEWS]
    reports += [column_types(tables[name], name, core_types(name)) for name in CORE_TYPES if name in tables]
    for name, columns in CORE_NOT_NULL.items():
        required = [not_null(name, c) for c in columns] if verify_nulls else []
        checks = [*required, *also.get(name, ())]
        if name in tables and checks:
            reports.append(run_table_checks(tables[name], checks))
    return stack_reports(reports)


def core_types(name: str) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(CORE_TYPES[name])}


class CheckRegistry:
    """Named checks, each a function of the tables that gives report rows."""

    def __init__(self):
        self._checks: dict[str, object] = {}

    def register(self, name: str, check) -> None:
        self._checks[name] = check

    def run(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        return stack_reports([check(tables) for check in self._checks.values()])

    @property
    def names(self) -> list[str]:
        return list(self._checks)
