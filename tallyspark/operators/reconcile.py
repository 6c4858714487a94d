"""Staging against warehouse: row counts, duplicates and money totals, as report rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.latest import VERSION_COLUMNS
from tallyspark.plans.dimensions import DIMENSIONS
from tallyspark.plans.facts import FACTS, latest_staged

Tables = Mapping[str, DataFrame]
Version = Sequence[str | Column]

# Report name -> (staging, key, staged amount, fact, fact amount)
TOTALS = {
    "order_total_amount": ("stg_order", "order_id", "total_amount", "fact_orders", "total_amount"),
    "payment_amount": ("stg_payment", "payment_id", "amount", "fact_payments", "amount"),
    "return_refund_amount": ("stg_return", "return_id", "refund_amount", "fact_returns", "refund_amount"),
    "purchase_line_total": ("stg_purchase_item", "purchase_item_id", "line_amount", "fact_purchases", "line_total"),
    "expense_amount": ("stg_expense", "expense_id", "amount", "fact_expenses", "amount"),
    "cash_transaction_amount": (
        "stg_cash_transaction", "transaction_id", "amount", "fact_cash_transactions", "amount",
    ),
}
TOTAL_TYPE = "decimal(38,2)"


def _sums_of_staged(t: Tables, staging: str, key: str, amount: str | None = None, version: Version = VERSION_COLUMNS) -> DataFrame:
    """One row: distinct accepted keys, and the exact sum over the latest row of each, from one pass over the staging.

    Tables that bring the latest rows themselves, as ``latest_…``, are counted on these: one row per key, from the shuffle
    that their facts read too.
    """
    total = F.coalesce(F.sum(amount), F.lit(0)).cast(TOTAL_TYPE) if amount else F.lit(None).cast(TOTAL_TYPE)
    if amount or f"latest_{staging}" in t:
        latest = latest_staged(t, staging, [key], version)
        return latest.agg(F.count(key).alias("expected_count"), total.alias("source_value"))
    pending = t[staging].where((F.col("record_status") == "pending") & F.col(key).isNotNull())
    return pending.agg(F.count_distinct(key).alias("expected_count")).withColumn("source_value", total)


def _sums_of_core(core: DataFrame, key: str, amount: str | None = None, repeated: bool = True) -> DataFrame:
    """One row: rows, repeated keys and the exact sum of a core table. Only repeated keys need a shuffle of the keys."""
    if not repeated:
        return core.agg(
            F.count("*").alias("actual_count"), F.lit(None).cast("bigint").alias("duplicate_count"),
            F.coalesce(F.sum(amount), F.lit(0)).cast(TOTAL_TYPE).alias("warehouse_value"),
        )
    value = F.sum(amount) if amount else F.lit(None)
    per_key = core.groupBy(key).agg(F.count("*").alias("n"), value.cast(TOTAL_TYPE).alias("value"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("actual_count"),
        F.count_if(F.col("n") > 1).alias("duplicate_count"),
        (F.coalesce(F.sum("value"), F.lit(0)) if amount else F.lit(None)).cast(TOTAL_TYPE).alias("warehouse_value"),
    )


def _side_by_side(pairs: Mapping[str, tuple[DataFrame, DataFrame]], name: str) -> DataFrame:
    """Per table its staged and its core sums in one row, with both verdicts; the total's is NULL for a table without one."""
    parts = [df.select(F.lit(n).alias(name), *df.columns) for n, both in pairs.items() for df in both]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    values = ["expected_count", "source_value", "actual_count", "duplicate_count", "warehouse_value"]
    rows = stacked.groupBy(name).agg(*[F.max(v).alias(v) for v in values])
    difference = F.col("source_value") - F.col("warehouse_value")
    return rows.select(
        "*", ((F.col("expected_count") == F.col("actual_count")) & (F.col("duplicate_count") == 0)).alias("is_valid"),
        difference.cast(TOTAL_TYPE).alias("difference"), (difference == 0).alias("total_is_valid"),
    )


def _dimensions(t: Tables) -> DataFrame:
    return _side_by_side({
        name: (
            _sums_of_staged(t, f"stg_{spec.staging}", spec.business_key),
            _sums_of_core(t[name].where(F.col(spec.current_column)), spec.business_key),
        )
        for name, spec in DIMENSIONS.items()
    }, "dimension_name")


def _facts(t: Tables, only: Sequence[str] = (), amounts: bool = False, version_of=lambda staging: VERSION_COLUMNS, repeated: bool = True) -> DataFrame:
    total_of = {fact: (key, amount, own) for _, key, amount, fact, own in TOTALS.values()} if amounts else {}
    pairs = {}
    for name, spec in FACTS.items():
        if only and name not in only:
            continue
        key = spec.business_key[-1]
        staged_key = key if name == "fact_partner_capital" else spec.staging_key
        _, amount, own = total_of.get(name, (None, None, None))
        pairs[name] = (_sums_of_staged(t, spec.staging, staged_key, amount, version_of(spec.staging)), _sums_of_core(t[name], key, own, repeated))
    return _side_by_side(pairs, "fact_name")


_COUNTS = ("expected_count", "actual_count", "duplicate_count", "is_valid")


def dimension_report(t: Tables) -> DataFrame:
    """Distinct accepted staged ids against current rows, per dimension."""
    return _dimensions(t).select("dimension_name", *_COUNTS)


def fact_report(t: Tables) -> DataFrame:
    """Distinct accepted staged keys against fact rows, per fact."""
    return _facts(t).select("fact_name", *_COUNTS)


def totals_report(t: Tables, version_of: Callable[[str], Version] = lambda staging: VERSION_COLUMNS) -> DataFrame:
    """Exact money totals of the latest accepted staged rows against the facts."""
    name_of = {fact: name for name, (_, _, _, fact, _) in TOTALS.items()}
    rows = _facts(t, list(name_of), True, version_of, repeated=False)
    names = F.create_map(*[F.lit(x) for pair in name_of.items() for x in pair])
    return rows.select(
        names[F.col("fact_name")].alias("metric_name"), "source_value", "warehouse_value", "difference", F.col("total_is_valid").alias("is_valid")
    )


def warehouse_report(t: Tables, version_of: Callable[[str], Version] = lambda staging: VERSION_COLUMNS) -> DataFrame:
    """One row per group of checks and one for all: is everything valid? Each table is read once for all its checks."""
    facts = _facts(t, (), True, version_of)
    rows = _dimensions(t).select(F.lit("dimensions").alias("check_group"), "is_valid").unionByName(
        facts.select(F.inline(F.array(
            F.struct(F.lit("facts").alias("check_group"), F.col("is_valid")),
            F.struct(F.lit("totals").alias("check_group"), F.col("total_is_valid").alias("is_valid")),
        ))).where("is_valid IS NOT NULL")
    )
    return rows.rollup("check_group").agg(
        F.bool_and("is_valid").alias("is_valid"), F.count("*").alias("check_count")
    ).withColumn("check_group", F.coalesce("check_group", F.lit("all")))


# Fact -> foreign key -> dimension, or the fact it belongs to
FOREIGN_KEYS = {
    "fact_orders": {"date_key": "dim_date", "customer_key": "dim_customer"},
    "fact_sales": {
        "date_key": "dim_date", "customer_key": "dim_customer", "product_key": "dim_product", "location_key": "dim_location",
    },
    "fact_payments": {"date_key": "dim_date", "customer_key": "dim_customer", "cash_account_key": "dim_cash_account"},
    "fact_returns": {
        "date_key": "dim_date", "customer_key": "dim_customer", "location_key": "dim_location",
        "cash_account_key": "dim_cash_account",
    },
    "fact_return_items": {"product_key": "dim_product", "return_id": "fact_returns"},
    "fact_purchases": {
        "date_key": "dim_date", "supplier_key": "dim_supplier", "product_key": "dim_product", "location_key": "dim_location",
    },
    "fact_cash_transactions": {"date_key": "dim_date", "cash_account_key": "dim_cash_account"},
    "fact_expenses": {"date_key": "dim_date", "cash_account_key": "dim_cash_account"},
    "fact_partner_capital": {"date_key": "dim_date", "partner_key": "dim_partner", "cash_account_key": "dim_cash_account"},
    "fact_stock_movements": {
        "date_key": "dim_date", "product_key": "dim_product", "from_location_key": "dim_location",
        "to_location_key": "dim_location",
    },
}


def fact_integrity(t: Tables, fact: str) -> DataFrame:
    """Repeated business keys and dangling foreign keys of a fact, to look at before it is published.

    A foreign key is counted per value first, so what meets the dimension is
    one row per value, however many fact rows share it.
    """
    spec, keys = FACTS[fact], FOREIGN_KEYS[fact]
    repeated = (
        t[fact].groupBy(*spec.business_key).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("broken_rows"))
    )
    parts = [repeated.select(F.lit(fact).alias("fact"), F.lit("unique " + ", ".join(spec.business_key)).alias("rule"), "broken_rows")]
    for key, dim in keys.items():
        dim_key = key.removeprefix("from_").removeprefix("to_")
        used = t[fact].where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
        known = t[dim].select(F.col(dim_key).alias("__known"))
        broken = used.join(known, used[key] == known["__known"], "left_anti").agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("broken_rows")
        )
        parts.append(broken.select(F.lit(fact).alias("fact"), F.lit(f"{key} in {dim}").alias("rule"), "broken_rows"))
    return reduce(lambda a, b: a.unionByName(b), parts)
