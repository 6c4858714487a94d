"""A request in business terms turned into a metric request, or into all its open issues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import resolve as rs
from tallyspark.plans.metric_query import Filter, MetricRequest
from tallyspark.plans.metrics import MetricRegistry, standard_registry

# dimension of names -> (table, id column, name column)
DIRECTORIES = {
    "customer_name": ("dim_customer", "customer_id", "customer_name"),
    "product_name": ("dim_product", "product_id", "product_name"),
    "supplier_name": ("dim_supplier", "supplier_id", "supplier_name"),
    "partner_name": ("dim_partner", "partner_id", "partner_name"),
    "location_name": ("dim_location", "stock_location_id", "location_name"),
    "cash_account_name": ("dim_cash_account", "cash_account_id", "account_name"),
    "from_location_name": ("dim_location", "stock_location_id", "location_name"),
    "to_location_name": ("dim_location", "stock_location_id", "location_name"),
}
NAME_OPERATORS = ("eq", "ne", "in", "not_in")


class UnresolvedTerms(ValueError):
    """Terms nobody can map to one meaning: (kind, term, status)."""

    def __init__(self, issues: Sequence[tuple[str, str, str]]):
        self.issues = list(issues)
        super().__init__("; ".join(f"{kind} {term!r}: {status}" for kind, term, status in self.issues))


def _resolved(terms: Sequence[str], spark: SparkSession, resolve) -> list[tuple[str, str, str | None]]:
    """(term, status, target) in the order of the request; a request holds a handful of terms."""
    if not terms:
        return []
    df = spark.createDataFrame(list(enumerate(terms)), "position int, term string")
    return [(r.term, r.status, r.resolved) for r in resolve(df).orderBy("position").collect()]


def resolve_request(
    spark: SparkSession, tables: Mapping[str, DataFrame], request: MetricRequest, registry: MetricRegistry | None = None
) -> MetricRequest:
    """Terms of the request replaced by metric, dimension and id names.

    Metrics come first: with an unknown metric nothing else can be judged.
    After that every open dimension and filter is reported, not only the first.
    """
    registry = registry or standard_registry()
    metrics = _resolved(
        request.metrics, spark, lambda df: rs.resolve_metrics(df, "term", rs.metric_vocabulary(spark, registry))
    )
    _raise_open([("metric", *m[:2]) for m in metrics])
    names = [m[2] for m in metrics]
    allowed = set.intersection(*[set(registry[n].dimensions) for n in names]) if names else set()

    def dimension(df: DataFrame) -> DataFrame:
        return rs.resolve_dimensions(df, "term", rs.dimension_vocabulary(spark, registry), sorted(allowed))

    dims = _resolved(request.dimensions, spark, dimension)
    fields = _resolved([f.field for f in request.filters], spark, dimension)
    issues = [("dimension", *d[:2]) for d in dims] + [("filter", *f[:2]) for f in fields]
    filters = []
    for f, (_, status, field) in zip(request.filters, fields):
        if status != rs.RESOLVED:
            continue
        if field in DIRECTORIES and f.operator in NAME_OPERATORS:
            found, ids = _entity_ids(spark, tables, field, f)
            issues += found
            field, value = rs.ENTITY_DIMENSIONS[field], ids
            filters.append(Filter(field, f.operator, value if f.operator in ("in", "not_in") else (value or [None])[0]))
        else:
            filters.append(Filter(field, f.operator, f.value))
    _raise_open(issues)
    return replace(request, metrics=names, dimensions=[d[2] for d in dims], filters=filters)


def _entity_ids(spark: SparkSession, tables: Mapping[str, DataFrame], field: str, f: Filter):
    values = list(f.value) if isinstance(f.value, (list, tuple)) else [f.value]
    table, id_column, name_column = DIRECTORIES[field]
    directory = tables[table].select(F.col(id_column).alias("id"), F.col(name_column).alias("name"))
    found = _resolved([str(v) for v in values], spark, lambda df: rs.resolve_entities(df, "term", directory))
    return [("filter value", term, status) for term, status, _ in found], [target for _, _, target in found]


def _raise_open(checked: Sequence[tuple[str, str, str]]) -> None:
    issues = [c for c in checked if c[2] != rs.RESOLVED]
    if issues:
        raise UnresolvedTerms(issues)
