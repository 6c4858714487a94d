"""Row rules: every broken rule of a row is kept, none stops the job."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALIDATION_ERROR = "validation_error"
TRANSFORM_ERROR = "transform_error"


@dataclass(frozen=True)
class Rule:
    """``broken`` is true for a row that violates the rule; NULL counts as kept."""

    message: str
    broken: Column
    kind: str = VALIDATION_ERROR


def required(field: str) -> Rule:
    return Rule(f"{field} is required.", F.col(field).isNull())


def not_negative(field: str) -> Rule:
    return Rule(f"{field} cannot be negative.", F.col(field) < 0)


def positive(field: str) -> Rule:
    return Rule(f"{field} must be greater than zero.", F.col(field) <= 0)


def one_of(field: str, *allowed: str) -> Rule:
    return Rule(f"{field} must be one of {', '.join(allowed)}.", ~F.col(field).isin(*allowed))


def not_later(first: str, second: str) -> Rule:
    return Rule(f"{first} cannot be later than {second}.", F.col(first) > F.col(second))


def broken_messages(rules: Iterable[Rule], kind: str | None = None) -> Column:
    """Array of the messages of all broken rules, in rule order."""
    checks = [F.when(r.broken, F.lit(r.message)) for r in rules if kind is None or r.kind == kind]
    if not checks:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*checks))


def check_rows(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Add ``errors``, ``error_type``, ``record_status`` and ``validation_error``.

    The text is put together with ``concat_ws``, which is compiled; the array
    of ``errors`` costs an interpreted expression and only where it is used.
    """
    rules = list(rules)
    text = F.concat_ws("; ", *[F.when(r.broken, F.lit(r.message)) for r in rules])
    unreadable = [F.coalesce(r.broken, F.lit(False)) for r in rules if r.kind == TRANSFORM_ERROR]
    kind = F.lit(VALIDATION_ERROR)
    if unreadable:
        kind = F.when(reduce(lambda a, b: a | b, unreadable), F.lit(TRANSFORM_ERROR)).otherwise(kind)
    invalid = F.col("validation_error").isNotNull()
    return (
        df.withColumns({"validation_error": F.nullif(text, F.lit("")), "errors": broken_messages(rules)})
        .withColumn("record_status", F.when(invalid, F.lit("invalid")).otherwise(F.lit("pending")))
        .withColumn("error_type", F.when(invalid, kind))
    )


def split_rows(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of a checked frame."""
    return (
        checked.where(F.col("record_status") == "pending"),
        checked.where(F.col("record_status") == "invalid"),
    )


class ConstraintViolation(ValueError):
    """Rows break a table constraint."""


def enforce_constraints(df: DataFrame, rules: Iterable[Rule], mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """Apply table constraints to rows about to be loaded.

    ``quarantine`` returns (rows that hold, rows that break with ``errors``).
    ``fail`` puts the check into the plan of the kept rows: the job raises on
    the first breaking row, and no extra pass is made.
    """
    rules = list(rules)
    if mode != "quarantine" or not rules:
        return split_judged(with_errors(df, rules), mode)
    # the conditions are compiled, the messages are put together for the breaking rows alone
    breaks = reduce(lambda a, b: a | b, [F.coalesce(r.broken, F.lit(False)) for r in rules])
    return df.where(~breaks), with_errors(df.where(breaks), rules)


def with_errors(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """``df`` with the messages of the rules each row breaks in ``errors``."""
    return df.withColumn("errors", broken_messages(list(rules)))


def split_judged(judged: DataFrame, mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """Kept and breaking rows of a frame with ``errors``, which is best written once before."""
    holds = F.size("errors") == 0
    if mode == "quarantine":
        return judged.where(holds).drop("errors"), judged.where(~holds)
    if mode == "fail":
        message = F.concat(F.lit("constraint broken: "), F.array_join("errors", "; "))
        guard = F.when(holds, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
        return judged.where(guard).drop("errors"), judged.where(~holds)
    raise ValueError(f"unknown mode: {mode}")


def return_reference_rule() -> Rule:
    """A customer return refers to an order only, a supplier return to a purchase only."""
    kind, order, purchase = F.col("return_type"), F.col("order_id"), F.col("purchase_id")
    customer = (kind == "CUSTOMER_RETURN") & order.isNotNull() & purchase.isNull()
    supplier = (kind == "SUPPLIER_RETURN") & purchase.isNotNull() & order.isNull()
    return Rule("return reference does not fit return_type.", ~F.coalesce(customer | supplier, F.lit(False)))


# table -> constraints on its rows
def table_constraints() -> dict[str, list[Rule]]:
    return {
        "fact_orders": [not_negative(c) for c in ("subtotal", "invoice_discount", "delivery_charge", "total_amount")],
        "fact_payments": [not_negative("amount")],
        "fact_purchases": [positive("quantity"), *map(not_negative, ("unit_cost", "item_discount", "line_total"))],
        "fact_returns": [*map(not_negative, ("refund_amount", "due_adjustment", "cash_refund")), return_reference_rule()],
        "fact_return_items": [positive("quantity"), *map(not_negative, ("unit_price", "line_amount", "returned_cogs"))],
        "fact_stock_movements": [positive("quantity"), one_of("direction", "IN", "OUT")],
        "fact_cash_transactions": [positive("amount"), one_of("direction", "IN", "OUT")],
        "fact_expenses": [positive("amount")],
        "fact_partner_capital": [positive("amount")],
    }
