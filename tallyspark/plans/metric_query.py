"""The metric query: metrics by dimensions and time, filtered, sorted, cut.

Metrics of one view are computed in one scan: each metric's fixed filter sits
inside its aggregate, and the union of the filters is also a row filter, so it
reaches the scan and drops groups no metric has a row for. Results of several
views are lined up on the grouping columns. Everything stays one lazy plan.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.calendar import GRAIN_UNITS, time_bucket
from tallyspark.operators.combine import combine_results
from tallyspark.operators.distinct import SKETCH_SIZE
from tallyspark.plans.metrics import FixedFilter, Metric, MetricRegistry, standard_registry
from tallyspark.plans.timeranges import TimeRange, resolve
from tallyspark.plans.views import SUMMARY, TENANT, VIEWS, compose_view, has_tenant

Tables = Mapping[str, DataFrame]

PERIOD = "period"

# dimensions that live in tables which may be too large to broadcast
LARGE_DIMENSIONS = ("dim_customer", "dim_product")


class InvalidRequest(ValueError):
    """A request that names something that cannot be computed."""


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class MetricRequest:
    metrics: Sequence[str]
    dimensions: Sequence[str] = ()
    filters: Sequence[Filter] = ()
    time_range: TimeRange | str | None = None
    time_grain: str | None = None
    order_by: Sequence[Sort] = ()
    limit: int | None = None
    compare: bool = False
    tenant_id: str | None = None
    row_cap: int | None = None
    options: dict[str, Any] = field(default_factory=dict)


COMPARISONS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "like": lambda c, v: c.like(v),
    "ilike": lambda c, v: c.ilike(v),
}
LISTS = {"in": lambda c, v: c.isin(*v), "not_in": lambda c, v: ~c.isin(*v)}
NULL_TESTS = {"is_null": lambda c: c.isNull(), "is_not_null": lambda c: c.isNotNull()}
OPERATORS = (*COMPARISONS, *LISTS, *NULL_TESTS, "between")

_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def filter_column(f: Filter) -> Column:
    """A filter as a condition with SQL's treatment of NULL."""
    c = F.col(f.field)
    if f.operator in NULL_TESTS:
        if f.value is not None:
            raise InvalidRequest(f"{f.operator} takes no value")
        return NULL_TESTS[f.operator](c)
    if f.operator in LISTS:
        if not isinstance(f.value, (list, tuple)) or not f.value:
            raise InvalidRequest(f"{f.operator} needs a list with at least one value")
        return LISTS[f.operator](c, f.value)
    if f.operator == "between":
        if not isinstance(f.value, (list, tuple)) or len(f.value) != 2:
            raise InvalidRequest("between needs two values")
        return c.between(*f.value)
    if f.operator not in COMPARISONS:
        raise InvalidRequest(f"unknown operator: {f.operator}")
    if f.value is None:
        raise InvalidRequest(f"{f.operator} needs a value")
    return COMPARISONS[f.operator](c, f.value)


def check_request(request: MetricRequest, registry: MetricRegistry) -> list[Metric]:
    """Raise for a request that cannot run, before any job starts."""
    if not request.metrics:
        raise InvalidRequest("a request needs at least one metric")
    try:
        metrics = [registry[name] for name in request.metrics]
    except KeyError as exc:
        raise InvalidRequest(str(exc.args[0])) from None
    for name in (*request.dimensions, *[f.field for f in request.filters]):
        if not _NAME.match(name):
            raise InvalidRequest(f"not a column name: {name!r}")
        for m in metrics:
            if name not in m.dimensions:
                raise InvalidRequest(f"{m.name} cannot be used with {name}")
    if len(set(request.dimensions)) != len(request.dimensions):
        raise InvalidRequest("a dimension appears twice")
    outputs = [*request.dimensions, *([PERIOD] if request.time_grain else []), *[m.output_field for m in metrics]]
    if len(set(outputs)) != len(outputs):
        raise InvalidRequest(f"output columns appear twice: {outputs}")
    if request.time_grain is not None:
        if request.time_grain not in GRAIN_UNITS:
            raise InvalidRequest(f"unknown time grain: {request.time_grain}")
        for m in metrics:
            if request.time_grain not in m.grains:
                raise InvalidRequest(f"{m.name} has no grain {request.time_grain}")
    for s in request.order_by:
        if s.field not in outputs:
            raise InvalidRequest(f"cannot sort by {s.field}: not in the result")
    for number in (request.limit, request.row_cap):
        if number is not None and (isinstance(number, bool) or not isinstance(number, int) or number <= 0):
            raise InvalidRequest("limit must be a positive whole number")
    for f in request.filters:
        filter_column(f)
    return metrics


def strategy(metrics: Sequence[Metric], compare: bool = False) -> str:
    """How the parts of a request relate: none, split, compare or side by side."""
    parts = {(m.view, frozenset(m.filters)) for m in metrics}
    if len(parts) == 1:
        return "none"
    if len({m.view for m in metrics}) == 1:
        return "split_metrics"
    return "compare_metrics" if compare else "side_by_side"


def _holds(filters: Sequence[FixedFilter]) -> Column | None:
    tests = [F.col(f.field).isin(*f.values) for f in filters]
    return reduce(lambda a, b: a & b, tests) if tests else None


def _aggregate(m: Metric, registry: MetricRegistry, grouped: bool) -> Column:
    if m.aggregation == "ratio":
        top, bottom = (_aggregate(registry[p], registry, grouped) for p in (m.numerator, m.denominator))
        if m.null_if_denominator_zero:
            bottom = F.nullif(bottom, F.lit(0))
        return top / bottom
    holds = _holds(m.filters)
    value = F.lit(1) if m.expression is None else F.col(m.expression)
    value = value if holds is None else F.when(holds, value)
    result = {
        "sum": F.sum, "count": F.count, "count_distinct": F.count_distinct, "average": F.avg,
        "approx_count_distinct": lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c, SKETCH_SIZE)),
    }[m.aggregation](value)
    if m.zero_if_no_data:
        return F.coalesce(result, F.lit(0))
    if grouped and holds is not None:
        # a group the metric has no row for counts as 0, one with NULL amounts only stays NULL
        return F.when(F.count_if(holds) > 0, result).otherwise(F.lit(0))
    return result


def _leaves(m: Metric, registry: MetricRegistry) -> list[Metric]:
    return [m] if m.aggregation != "ratio" else [registry[m.numerator], registry[m.denominator]]


def _date_column(view: str) -> str:
    return "business_date" if view == SUMMARY else VIEWS[view].date_column


def _one_view(
    tables: Tables, view: str, metrics: Sequence[Metric], request: MetricRequest, registry: MetricRegistry,
    bounds: tuple[dt.date | None, dt.date | None],
) -> DataFrame:
    leaves = [leaf for m in metrics for leaf in _leaves(m, registry)]
    used = [*request.dimensions, *[f.field for f in request.filters]]
    used += [leaf.expression for leaf in leaves if leaf.expression]
    used += [f.field for leaf in leaves for f in leaf.filters]
    used += [_date_column(view)] if request.time_grain else []
    columns = list(dict.fromkeys(used))
    early = _large_dimension_columns(view, request) if _decomposable(leaves) else {}
    all_joins = bool(request.options.get("all_joins"))
    if early and not all_joins:
        return _aggregate_before_join(tables, view, metrics, request, registry, bounds, columns, early)
    rows = _with_tenant(compose_view, request, tables, view, columns or ["date_key"], *bounds, all_joins=all_joins)
    rows = _filtered(rows, leaves, request)
    return _grouped(rows, view, metrics, request, registry)


def _with_tenant(compose, request: MetricRequest, tables: Tables, view: str, columns: Sequence[str], *bounds, **options) -> DataFrame:
    """The view with the tenant of each row where the request has one.

    Facts that carry a ``tenant_id`` column say so themselves; for a warehouse
    of one tenant the request's option ``view_tenant`` names it.
    """
    if request.tenant_id is None:
        return compose(tables, view, columns, *bounds, **options)
    if has_tenant(tables, view):
        return compose(tables, view, [TENANT, *columns], *bounds, **options)
    if "view_tenant" not in request.options:
        raise InvalidRequest("the views carry no tenant")
    return compose(tables, view, columns, *bounds, **options).withColumn(TENANT, F.lit(request.options["view_tenant"]))


def _filtered(rows: DataFrame, leaves: Sequence[Metric], request: MetricRequest) -> DataFrame:
    if request.tenant_id is not None:
        rows = rows.where(F.col(TENANT) == request.tenant_id)
    for f in request.filters:
        rows = rows.where(filter_column(f))
    tests = [_holds(leaf.filters) for leaf in leaves]
    if all(t is not None for t in tests):
        rows = rows.where(reduce(lambda a, b: a | b, tests))
    return rows


def _grouped(
    rows: DataFrame, view: str, metrics: Sequence[Metric], request: MetricRequest, registry: MetricRegistry
) -> DataFrame:
    keys = [F.col(d) for d in request.dimensions]
    if request.time_grain:
        keys.append(_period(request, view))
    measures = [_aggregate(m, registry, bool(keys)).alias(m.output_field) for m in metrics]
    return rows.groupBy(*keys).agg(*measures) if keys else rows.agg(*measures)


def _period(request: MetricRequest, view: str) -> Column:
    """The bucket of a row's day, moved by the shift of an earlier period first."""
    day = F.col(_date_column(view))
    shift = request.options.get("period_shift")
    if shift:
        day = F.add_months(day, shift["months"]) if "months" in shift else F.date_add(day, shift["days"])
    return time_bucket(request.time_grain, day).alias(PERIOD)


def _decomposable(leaves: Sequence[Metric]) -> bool:
    return all(leaf.aggregation == "sum" and leaf.zero_if_no_data for leaf in leaves)


def _large_dimension_columns(view: str, request: MetricRequest) -> dict[str, str]:
    """Grouping columns that come from a table which may be too large to broadcast -> its key."""
    if view == SUMMARY:
        return {}
    return {
        c: dim.fact_key
        for dim in VIEWS[view].dims
        if dim.table in LARGE_DIMENSIONS
        for c in dim.columns
        if c in request.dimensions and dim.columns[c] != dim.dim_key
    }


def _aggregate_before_join(
    tables: Tables, view: str, metrics: Sequence[Metric], request: MetricRequest, registry: MetricRegistry,
    bounds: tuple[dt.date | None, dt.date | None], columns: Sequence[str], early: Mapping[str, str],
) -> DataFrame:
    """Sums per dimension key first, then the join: the join sees one row per key, not per fact row."""
    leaves = {leaf.name: leaf for m in metrics for leaf in _leaves(m, registry)}
    first_columns = [c for c in columns if c not in early]
    first_columns += [k for k in dict.fromkeys(early.values()) if k not in first_columns]
    late = [f for f in request.filters if f.field in early]
    sooner = _changed(request, filters=[f for f in request.filters if f not in late])
    rows = _filtered(_with_tenant(compose_view, request, tables, view, first_columns, *bounds), list(leaves.values()), sooner)
    inner_keys = [F.col(k) for k in dict.fromkeys(early.values())]
    inner_keys += [F.col(d) for d in request.dimensions if d not in early]
    if request.time_grain:
        inner_keys.append(_period(request, view))
    sums = []
    for name, leaf in leaves.items():
        holds = _holds(leaf.filters)
        value = F.col(leaf.expression)
        sums.append(F.sum(value if holds is None else F.when(holds, value)).alias(f"__{name}"))
    partial = rows.groupBy(*inner_keys).agg(*sums)
    for dim in VIEWS[view].dims:
        wanted = [c for c in early if c in dim.columns]
        if wanted:
            side = tables[dim.table].select(
                F.col(dim.dim_key).alias(dim.fact_key), *[F.col(dim.columns[c]).alias(c) for c in wanted]
            )
            partial = partial.join(side, dim.fact_key, dim.how)
    for f in late:
        partial = partial.where(filter_column(f))

    def total(m: Metric) -> Column:
        if m.aggregation == "ratio":
            top, bottom = total(registry[m.numerator]), total(registry[m.denominator])
            return top / (F.nullif(bottom, F.lit(0)) if m.null_if_denominator_zero else bottom)
        return F.coalesce(F.sum(f"__{m.name}"), F.lit(0))

    return partial.groupBy(*request.dimensions, *([PERIOD] if request.time_grain else [])).agg(*[total(m).alias(m.output_field) for m in metrics])


def metric_query(
    tables: Tables, request: MetricRequest, registry: MetricRegistry | None = None, today: dt.date | None = None
) -> DataFrame:
    """Result of a metric request: dimensions, period, then one column per metric."""
    registry = registry or standard_registry()
    metrics = check_request(request, registry)
    if request.options.get("require_tenant") and request.tenant_id is None:
        raise InvalidRequest("an unscoped request is not allowed")
    bounds = resolve(request.time_range, today)
    by_view: dict[str, list[Metric]] = {}
    for m in metrics:
        by_view.setdefault(m.view, []).append(m)
    keys = [*request.dimensions, *([PERIOD] if request.time_grain else [])]
    parts = [
        (_one_view(tables, view, members, request, registry, bounds), [m.output_field for m in members])
        for view, members in by_view.items()
    ]
    result = parts[0][0] if len(parts) == 1 else combine_results(parts, keys)
    result = result.select(*keys, *[m.output_field for m in metrics])
    return _sorted_and_cut(result, request)


def _sorted_and_cut(result: DataFrame, request: MetricRequest) -> DataFrame:
    if request.order_by:
        # NULLs last ascending, first descending
        result = result.orderBy(
            *[
                F.col(s.field).desc_nulls_first() if s.descending else F.col(s.field).asc_nulls_last()
                for s in request.order_by
            ]
        )
    limits = [n for n in (request.limit, request.row_cap) if n is not None]
    return result.limit(min(limits)) if limits else result


def compare_periods(
    tables: Tables, request: MetricRequest, mode: str, registry: MetricRegistry | None = None,
    today: dt.date | None = None,
) -> DataFrame:
    """A request next to the same request one period or one year earlier (``previous_`` columns).

    With a time grain every earlier day counts in the bucket of the day it is compared with, so the
    buckets of both periods meet.
    """
    start, end = resolve(request.time_range, today)
    if start is None or end is None:
        raise InvalidRequest("a period comparison needs a range with both ends")
    if mode == "previous_period":
        days = end - start + dt.timedelta(days=1)
        earlier, shift = TimeRange(start=start - days, end=end - days), {"days": days.days}
    elif mode == "same_period_last_year":
        earlier, shift = TimeRange(start=_year_before(start), end=_year_before(end)), {"months": 12}
    else:
        raise InvalidRequest(f"unknown comparison: {mode}")
    registry = registry or standard_registry()
    names = [registry[m].output_field for m in request.metrics]
    plain = {"order_by": (), "limit": None, "row_cap": None}
    now = metric_query(tables, _changed(request, time_range=TimeRange(start=start, end=end), **plain), registry)
    moved = {**request.options, "period_shift": shift}
    then = metric_query(tables, _changed(request, time_range=earlier, options=moved, **plain), registry)
    then = then.withColumnsRenamed({n: f"previous_{n}" for n in names})
    keys = [*request.dimensions, *([PERIOD] if request.time_grain else [])]
    both = combine_results([(now, names), (then, [f"previous_{n}" for n in names])], keys)
    return _sorted_and_cut(both, request)


def _year_before(day: dt.date) -> dt.date:
    leap_day = day.month == 2 and day.day == 29
    return day.replace(year=day.year - 1, day=28 if leap_day else day.day)


def _changed(request: MetricRequest, **kw) -> MetricRequest:
    return MetricRequest(**{**request.__dict__, **kw})
