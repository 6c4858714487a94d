"""What each of the 17 text exports holds, and how its cells become values.

A spec drives reading, hashing, typing, validation and staging of one entity;
there is no code per entity.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions import cleaning as cl
from tallyspark.operators import rules as ru

# parser name -> (expression over a cell and whether it is trimmed, Spark type, kind of error an unreadable cell is)
PARSERS: dict[str, tuple[Callable[[str, bool], Column], str, str]] = {
    "text": (lambda c, is_trimmed=False: F.col(c) if is_trimmed else cl.clean_text(c), "string", ru.VALIDATION_ERROR),
    "date_day_first": (cl.parse_date_day_first, "date", ru.TRANSFORM_ERROR),
    "date_month_first": (cl.parse_date_month_first, "date", ru.VALIDATION_ERROR),
    "timestamp_basic": (cl.parse_timestamp_basic, "timestamp", ru.TRANSFORM_ERROR),
    "timestamp_wide": (cl.parse_timestamp_wide, "timestamp", ru.VALIDATION_ERROR),
    "int": (cl.parse_int, "int", ru.TRANSFORM_ERROR),
    "money": (lambda c, is_trimmed=False: cl.parse_decimal(c, cl.MONEY, is_trimmed), cl.MONEY, ru.TRANSFORM_ERROR),
    "quantity": (lambda c, is_trimmed=False: cl.parse_decimal(c, cl.QUANTITY, is_trimmed), cl.QUANTITY, ru.TRANSFORM_ERROR),
    "money_commas": (lambda c, is_trimmed=False: cl.parse_decimal_commas(c, cl.MONEY, is_trimmed), cl.MONEY, ru.TRANSFORM_ERROR),
    "quantity_commas": (lambda c, is_trimmed=False: cl.parse_decimal_commas(c, cl.QUANTITY, is_trimmed), cl.QUANTITY, ru.TRANSFORM_ERROR),
    "money_dollars": (lambda c, is_trimmed=False: cl.parse_decimal_dollars(c, cl.MONEY, is_trimmed), cl.MONEY, ru.VALIDATION_ERROR),
    "amount": (lambda c, is_trimmed=False: cl.parse_amount(c, cl.MONEY, is_trimmed), cl.MONEY, ru.TRANSFORM_ERROR),
    "quantity_signed": (cl.parse_quantity, cl.QUANTITY, ru.TRANSFORM_ERROR),
    "boolean": (cl.parse_boolean, "boolean", ru.TRANSFORM_ERROR),
}


@dataclass(frozen=True)
class Staged:
    """A staging column. ``source`` None means the export has no such value."""

    name: str
    source: str | tuple[str, ...] | None
    parser: str = "text"

    @property
    def spark_type(self) -> str:
        return PARSERS[self.parser][1]


@dataclass(frozen=True)
class EntitySpec:
    name: str
    file: str
    header: tuple[str, ...]
    key: str
    staged: tuple[Staged, ...]
    required: tuple[str, ...]
    checks: Callable[[], list[ru.Rule]] = list
    raw_names: dict[str, str] = field(default_factory=dict)
    skip_known_rows: bool = True

    def raw_name(self, header: str) -> str:
        return self.raw_names.get(header, header.lower())

    @property
    def raw_columns(self) -> tuple[str, ...]:
        return tuple(self.raw_name(h) for h in self.header)

    @property
    def table(self) -> str:
        return self.file.lower()

    def typed_columns(self, is_trimmed: bool = False) -> list[Column]:
        """Staging values as expressions over the raw text columns, which may be trimmed and empty ones NULL already."""
        columns = []
        for f in self.staged:
            parse, spark_type, _ = PARSERS[f.parser]
            if f.source is None:
                value = F.lit(None).cast(spark_type)
            elif isinstance(f.source, tuple):
                value = F.coalesce(*[parse(s, is_trimmed) for s in f.source])
            else:
                value = parse(f.source, is_trimmed)
            columns.append(value.alias(f.name))
        return columns

    def rules(self, raw_prefix: str) -> list[ru.Rule]:
        """Parse failures first, then required fields, then value rules.

        The raw cells under ``raw_prefix`` have to be trimmed, empty ones NULL.
        """
        found = []
        for f in self.staged:
            if f.parser == "text" or not isinstance(f.source, str):
                continue
            _, spark_type, kind = PARSERS[f.parser]
            broken = F.col(raw_prefix + f.source).isNotNull() & F.col(f.name).isNull()
            found.append(ru.Rule(f"{f.name} could not be read as {spark_type}.", broken, kind))
        found += [ru.required(c) for c in self.required]
        return found + self.checks()


def _parse_fields(text: str) -> tuple[Staged, ...]:
    """``name[=source[|source]][:parser]`` per word; ``=-`` means no source."""
    out = []
    for word in text.split():
        left, _, parser = word.partition(":")
        name, eq, source = left.partition("=")
        src: str | tuple[str, ...] | None = name
        if eq:
            src = None if source == "-" else tuple(source.split("|")) if "|" in source else source
        out.append(Staged(name, src, parser or "text"))
    return tuple(out)


def _spec(name: str, file: str, header: str, staged: str, required: str, **kw) -> EntitySpec:
    fields = _parse_fields(staged)
    return EntitySpec(name, file, tuple(header.split()), fields[0].name, fields, tuple(required.split()), **kw)


def _non_negative(*names: str) -> Callable[[], list[ru.Rule]]:
    return lambda: [ru.not_negative(n) for n in names]


# Export headers, staging columns, required fields and value rules.
_ALL = (
    _spec(
        "customer", "Customers",
        "Customer_ID Customer_Name Contact Address First_Order_Date Last_Order_Date Total_Orders Total_Spent"
        " Total_Paid Total_Due Status",
        "customer_id customer_name contact address first_order_date:date_day_first last_order_date:date_day_first"
        " total_orders:int total_spent:money total_paid:money total_due:money status",
        "customer_id customer_name",
        checks=lambda: [
            ru.not_later("first_order_date", "last_order_date"),
            *_non_negative("total_orders", "total_spent", "total_paid", "total_due")(),
        ],
        skip_known_rows=False,
    ),
    _spec(
        "product", "Products",
        "Product_ID Product_Name Category Unit Selling_Price Cost_Price Opening_Stock Reorder_Level Active",
        "product_id product_name category unit selling_price:money cost_price:money opening_stock:quantity"
        " reorder_level:quantity active:boolean",
        "product_id product_name",
        checks=_non_negative("selling_price", "cost_price", "opening_stock", "reorder_level"),
        skip_known_rows=False,
    ),
    _spec(
        "partner", "Partners", "Partner_ID Partner_Name Role Active",
        "partner_id partner_name active:boolean", "partner_id partner_name",
    ),
    _spec(
        "supplier", "Suppliers", "Supplier_ID Supplier_Name Contact Address Active",
        "supplier_id supplier_name contact address active:boolean", "supplier_id supplier_name",
    ),
    _spec(
        "stock_location", "Stock_Locations", "Stock_Location_ID Location_Name Location_Type Partner_ID Active",
        "stock_location_id location_name location_type partner_id active:boolean", "stock_location_id location_name",
    ),
    _spec(
        "cash_account", "Cash_Accounts",
        "Cash_Account_ID Account_Name Account_Type Owner_ID Active Total_In Total_Out Current_Balance",
        "cash_account_id account_name account_type owner_id active:boolean total_in:money_commas"
        " total_out:money_commas current_balance:money_commas",
        "cash_account_id account_name",
        checks=_non_negative("total_in", "total_out"),
    ),
    _spec(
        "order", "Orders",
        "Order_ID Order_Date Customer_ID Subtotal Discount Delivery_Charge Total_Amount Paid Due Order_Status"
        " Collected_By Created_At",
        "order_id order_date:date_day_first customer_id subtotal:money discount:money delivery_charge:money"
        " total_amount:money paid_amount=paid:money due_amount=due:money order_status collected_by"
        " source_created_at=created_at:timestamp_basic",
        "order_id order_date",
        checks=_non_negative("subtotal", "discount", "delivery_charge", "total_amount", "paid_amount", "due_amount"),
    ),
    _spec(
        "order_item", "Order_Items",
        "Order_Item_ID Order_ID Product_ID Quantity Unit_Price Cost_Price Discount Line_Total COGS"
        " Fulfilled_From_Location_ID",
        "order_item_id order_id product_id stock_location_id=fulfilled_from_location_id quantity:quantity_commas"
        " unit_price:money_commas cost_price:money_commas line_amount=line_total:money_commas"
        " item_discount=discount:money_commas cogs:money_commas",
        "order_item_id order_id product_id quantity",
        checks=_non_negative("quantity", "unit_price", "cost_price", "line_amount", "item_discount", "cogs"),
    ),
    _spec(
        "payment", "Payments",
        "Payment_ID Payment_Date Order_ID Customer_ID Amount Payment_Method Cash_Account_ID Collected_By Notes Created_At",
        "payment_id payment_date:date_day_first customer_id order_id amount:money payment_method collected_by"
        " cash_account_id notes source_created_at=created_at:timestamp_basic",
        "payment_id payment_date amount",
        checks=lambda: [ru.positive("amount")],
    ),
    _spec(
        "purchase", "Purchases",
        "Purchase_ID Purchase_Date Supplier_ID Subtotal Discount Other_Charges Total_Amount Paid Due Payment_Method"
        " Cash_Account_ID Purchased_By Purchase_Status Notes Created_At",
        "purchase_id purchase_date:date_month_first supplier_id subtotal:money_dollars discount:money_dollars"
        " other_charges:money_dollars total_amount:money_dollars paid_amount=paid:money_dollars"
        " due_amount=due:money_dollars payment_method cash_account_id purchased_by purchase_status notes"
        " source_created_at=created_at:timestamp_wide",
        "purchase_id purchase_date",
    ),
    _spec(
        "purchase_item", "Purchase_Items",
        "Purchase_Item_ID Purchase_ID Product_ID Quantity Unit_Cost Discount Line_Total Stock_Location_ID",
        "purchase_item_id purchase_id product_id stock_location_id quantity:quantity unit_cost:money"
        " item_discount=discount:money line_amount=line_total:money",
        "purchase_item_id purchase_id product_id quantity",
    ),
    _spec(
        "return", "Returns",
        "Return_ID Return_Date Return_Type Reference_Order_ID Reference_Purchase_ID Location_ID Refund_Amount"
        " Cash_Account_ID Returned_By Reason Status Notes Created_At",
        "return_id return_date:date_day_first customer_id=- order_id=reference_order_id total_amount=-:money"
        " refund_amount:money adjustment_amount=-:money return_status=status notes return_type"
        " purchase_id=reference_purchase_id location_id cash_account_id returned_by reason"
        " source_created_at=created_at:timestamp_basic",
        "return_id return_date",
        checks=_non_negative("refund_amount", "total_amount", "adjustment_amount"),
    ),
    _spec(
        "return_item", "Return_Items",
        "Return_Item_ID Return_ID Product_ID Quantity Unit_Price Line_Amount",
        "return_item_id return_id order_item_id=- product_id quantity:quantity unit_price:money"
        " amount=line_amount:money",
        "return_item_id return_id product_id quantity",
        checks=lambda: [ru.positive("quantity"), *_non_negative("unit_price", "amount")()],
    ),
    _spec(
        "stock_movement", "Stock_Movements",
        "Movement_ID Movement_Date Product_ID Movement_Type Reference_ID Quantity Direction From_Location_ID"
        " To_Location_ID Notes Created_At",
        "movement_id movement_date:date_month_first product_id movement_type direction quantity:quantity_signed"
        " from_location_id to_location_id reference_id notes source_created_at=created_at:timestamp_wide",
        "movement_id movement_date product_id movement_type quantity",
    ),
    _spec(
        "cash_transaction", "Cash_Transactions",
        "Transaction_ID Transaction_Date Cash_Account_ID Direction Transaction_Type Reference_ID Amount Description"
        " Created_By Created_At",
        "transaction_id=cash_transaction_id transaction_date:date_month_first cash_account_id transaction_type"
        " amount:money related_partner_id=- reference_id notes=- direction reference_type=- description created_by"
        " source_created_at=created_at:timestamp_wide",
        "transaction_id transaction_type transaction_date amount",
        raw_names={"Transaction_ID": "cash_transaction_id"},
    ),
    _spec(
        "expense", "Expenses",
        "Expense_ID Expense_Date Expense_Category Description Amount Payment_Method Cash_Account_ID Paid_By"
        " Reference_ID Created_By Created_At",
        "expense_id expense_date:date_month_first expense_category description amount:amount payment_method paid_by"
        " paid_by_partner_id=- cash_account_id reference_id created_by source_created_at=created_at:timestamp_wide",
        "expense_id expense_date amount",
    ),
    _spec(
        "partner_capital", "Partner_Capital",
        "Capital_Transaction_ID Transaction_Date Transaction_Type Partner_ID Cash_Account_ID Amount Reference_ID"
        " Notes Created_By Created_At",
        "partner_capital_entry_id=capital_transaction_id|cash_transaction_id entry_date=transaction_date:date_month_first"
        " partner_id transaction_type amount:amount cash_account_id notes capital_transaction_id reference_id"
        " created_by source_created_at=created_at:timestamp_wide",
        "partner_capital_entry_id entry_date partner_id transaction_type amount",
    ),
)

ENTITIES: dict[str, EntitySpec] = {spec.name: spec for spec in _ALL}
