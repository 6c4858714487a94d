"""The named metrics and what each may be grouped and filtered by."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from tallyspark.functions.calendar import GRAIN_UNITS
from tallyspark.plans.views import SUMMARY, VIEWS

AGGREGATIONS = ("sum", "count", "count_distinct", "approx_count_distinct", "average", "ratio")


@dataclass(frozen=True)
class FixedFilter:
    """Rows of the view a metric is about."""

    field: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Metric:
    """A named aggregate over one view.

    ``expression`` is the aggregated column (None counts rows). An approximate
    distinct count is an HLL estimate of bounded memory. A ratio names
    its ``numerator`` and ``denominator`` metrics instead, both of one view.
    """

    name: str
    view: str
    aggregation: str
    expression: str | None
    dimensions: tuple[str, ...] = ()
    filters: tuple[FixedFilter, ...] = ()
    grains: tuple[str, ...] = tuple(GRAIN_UNITS)
    display_name: str = ""
    description: str = ""
    output: str = ""
    zero_if_no_data: bool = True
    aliases: tuple[str, ...] = ()
    numerator: str | None = None
    denominator: str | None = None
    null_if_denominator_zero: bool = True

    @property
    def output_field(self) -> str:
        return self.output or self.name


class UnknownMetric(KeyError):
    """No metric of that name is registered."""


@dataclass
class MetricRegistry(Mapping[str, Metric]):
    """Metrics by name; users add their own with ``add``."""

    metrics: dict[str, Metric] = field(default_factory=dict)

    def __getitem__(self, name: str) -> Metric:
        try:
            return self.metrics[name]
        except KeyError:
            raise UnknownMetric(f"Unknown metric: {name}") from None

    def __iter__(self) -> Iterator[str]:
        return iter(self.metrics)

    def __len__(self) -> int:
        return len(self.metrics)

    def add(self, metric: Metric) -> None:
        problems = self.problems_of(metric)
        if problems:
            raise ValueError("; ".join(problems))
        self.metrics[metric.name] = metric

    def problems_of(self, metric: Metric) -> list[str]:
        """What is wrong with a metric against the columns of its view."""
        found = []
        if metric.aggregation not in AGGREGATIONS:
            found.append(f"{metric.name}: unknown aggregation {metric.aggregation}")
        if metric.view != SUMMARY and metric.view not in VIEWS:
            return [*found, f"{metric.name}: unknown view {metric.view}"]
        if metric.view != SUMMARY:
            columns = VIEWS[metric.view].columns
            used = [*metric.dimensions, *[f.field for f in metric.filters]]
            used += [metric.expression] if metric.expression else []
            found += [f"{metric.name}: {metric.view} has no column {c}" for c in used if c not in columns]
        if metric.aggregation == "ratio":
            parts = (metric.numerator, metric.denominator)
            if any(p not in self.metrics for p in parts):
                found.append(f"{metric.name}: ratio of unknown metrics {parts}")
            elif any(self.metrics[p].view != metric.view for p in parts):
                found.append(f"{metric.name}: ratio parts come from another view")
        found += [f"{metric.name}: unknown grain {g}" for g in metric.grains if g not in GRAIN_UNITS]
        return found

    def dimensions(self) -> list[str]:
        return sorted({d for m in self.metrics.values() for d in m.dimensions})


def _pairs(*names: str) -> tuple[str, ...]:
    return tuple(f"{n}_{part}" for n in names for part in ("id", "name"))


# Metric names, columns, filters, dimensions and the terms users say.
def standard_registry(capital_in: Sequence[str] = ("CAPITAL",)) -> MetricRegistry:
    """The 18 metrics. ``capital_in`` says which transaction types bring capital in."""
    incoming, outgoing = (FixedFilter("direction", ("IN",)),), (FixedFilter("direction", ("OUT",)),)
    cash = (*_pairs("cash_account"), "transaction_type", "amount", "created_by")
    capital = (*_pairs("partner", "cash_account"), "transaction_type")
    stock = (*_pairs("product", "from_location", "to_location"), "movement_type")
    registry = MetricRegistry()
    for metric in (
        Metric(
            "number_of_orders", "v_orders", "count_distinct", "order_id",
            (*_pairs("customer"), "order_status", "collected_by"), display_name="Total Orders",
            aliases=(
                "orders received", "orders", "order count", "how many orders", "total orders", "How many purchases",
            ),
        ),
        Metric(
            "gross_sales", "v_sales", "sum", "gross_sales",
            (*_pairs("customer", "product"), "product_category", *_pairs("location")), display_name="Gross Sales",
            aliases=(
                "revenue", "total revenue", "sales", "total sales", "sales amount", "earn", "earnings",
                "gross revenue", "top line",
            ),
        ),
        Metric(
            "net_sales", SUMMARY, "sum", "net_sales", display_name="Net Sales",
            aliases=(
                "net revenue", "net income", "sales after returns", "final sales", "earn after returns",
                "revenue after returns", "revenue after customer returns", "earn", "earnings", "income",
            ),
        ),
        Metric(
            "total_payments", "v_payments", "sum", "amount",
            (*_pairs("customer", "cash_account"), "payment_method", "collected_by"), display_name="Total Payments",
            aliases=(
                "collections", "payments", "payment received", "money received", "amount received", "receipts",
                "customers pay us in total",
            ),
        ),
        Metric(
            "total_returns", "v_returns", "count_distinct", "return_id",
            ("return_type", *_pairs("customer", "location", "cash_account"), "status", "returned_by"),
            display_name="Total Returns",
            aliases=("returns", "return count", "number of returns", "returned items"),
        ),
        Metric(
            "return_amount", "v_returns", "sum", "refund_amount",
            ("return_type", *_pairs("customer", "location"), "status"), display_name="Return Amount",
            aliases=("refund amount", "total refunds", "value of returns", "returns value"),
        ),
        Metric(
            "cash_refund", "v_returns", "sum", "cash_refund", ("return_type", *_pairs("customer", "cash_account")),
            display_name="Cash Refund",
            aliases=("cash refunded", "refunded in cash", "cash returned"),
        ),
        Metric(
            "due_adjustment", "v_returns", "sum", "due_adjustment", ("return_type", *_pairs("customer"), "status"),
            display_name="Due Adjustment",
            aliases=("due adjusted", "adjusted against dues", "due settlement"),
        ),
        Metric(
            "total_purchases", "v_purchases", "sum", "line_total", _pairs("supplier", "product", "location"),
            display_name="Total Purchases",
            aliases=("purchases", "total purchase value", "purchase amount", "procurement spend"),
        ),
        Metric(
            "purchase_transactions", "v_purchases", "count_distinct", "purchase_id", _pairs("supplier", "location"),
            display_name="Purchase Transactions",
            aliases=("purchase count", "number of purchases", "purchases made"),
        ),
        Metric(
            "cash_in", "v_cash_transactions", "sum", "amount", cash, incoming, display_name="Cash In",
            aliases=("cash inflow", "cash in", "money coming in", "cash received", "money came into"),
        ),
        Metric(
            "cash_out", "v_cash_transactions", "sum", "amount", cash, outgoing, display_name="Cash Out",
            aliases=(
                "cash outflow", "cash out", "money going out", "cash spent", "cash disbursed", "money left",
            ),
        ),
        Metric(
            "total_expenses", "v_expenses", "sum", "amount",
            ("expense_category", *_pairs("cash_account"), "paid_by", "amount"), display_name="Total Expenses",
            aliases=(
                "expenses", "business expenses", "spending", "money spent", "what did we spend", "total spent",
                "expenditure",
            ),
        ),
        Metric(
            "capital_invested", "v_partner_capital", "sum", "amount", capital,
            (FixedFilter("transaction_type", tuple(capital_in)),), display_name="Capital Invested",
            aliases=(
                "capital added", "capital contribution", "capital invested", "partner investment",
                "partners put into", "investors put into",
            ),
        ),
        Metric(
            "capital_withdrawn", "v_partner_capital", "sum", "amount", capital,
            (FixedFilter("transaction_type", ("WITHDRAWAL",)),), display_name="Capital Withdrawn",
            aliases=(
                "capital withdrawn", "capital withdrawal", "partner withdrawal", "capital taken out",
                "money withdrawn",
            ),
        ),
        Metric(
            "stock_in_quantity", "v_stock_movements", "sum", "quantity", stock, incoming,
            display_name="Stock In Quantity",
            aliases=("stock in", "inventory received", "stock received", "goods received"),
        ),
        Metric(
            "stock_out_quantity", "v_stock_movements", "sum", "quantity", stock, outgoing,
            display_name="Stock Out Quantity",
            aliases=("stock out", "inventory issued", "stock issued", "goods issued"),
        ),
        Metric(
            "gross_business_margin", SUMMARY, "sum", "gross_business_margin", display_name="Gross Business Margin",
            aliases=("profit", "margin", "business margin", "gross margin", "earn", "income"),
        ),
    ):
        registry.add(metric)
    return registry
