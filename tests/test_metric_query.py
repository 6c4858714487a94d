import datetime as dt
from dataclasses import replace
from decimal import Decimal

import pytest

from tallyspark.plans.metric_query import Filter, InvalidRequest, MetricRequest, Sort, compare_periods, metric_query, strategy
from tallyspark.plans.metrics import Metric, UnknownMetric, standard_registry
from tallyspark.plans.spoken_request import UnresolvedTerms, resolve_request
from tallyspark.plans.timeranges import TimeRange, UnknownTimeRange
from tallyspark.plans.views import SUMMARY, VIEWS, compose_view, for_tenant
from tests.conftest import day, money, rows
from tests.golden import golden_tables

JAN, FEB, MAR = day("2026-01-01"), day("2026-02-01"), day("2026-03-01")


@pytest.fixture(scope="module")
def tables(spark):
    return golden_tables(spark)


def ask(tables, *metrics, **kw):
    return metric_query(tables, MetricRequest(list(metrics), **kw))


def test_sales_by_category(tables):
    assert rows(ask(tables, "gross_sales", dimensions=["product_category"])) == [("Nuts", money("1500.00")), ("Snacks", money("1650.25"))]


def test_sales_monthly(tables):
    got = rows(ask(tables, "gross_sales", time_grain="monthly"))
    assert got == [(JAN, money("1750.25")), (FEB, money("1400.00"))]
    assert sum(r[1] for r in got) == money("3150.25")


def test_two_directions_of_one_view(tables):
    assert rows(ask(tables, "cash_in", "cash_out", time_grain="monthly")) == [
        (JAN, money("10000.00"), money("7000.00")), (FEB, money("12000.00"), money("0.00")), (MAR, money("0.00"), money("5000.00")),
    ]


def test_compare_two_views(tables):
    assert rows(ask(tables, "gross_sales", "total_expenses", time_grain="monthly", compare=True)) == [
        (JAN, money("1750.25"), money("360.00")), (FEB, money("1400.00"), money("300.00")),
    ]


def test_side_by_side(tables):
    assert rows(ask(tables, "gross_sales", "total_expenses")) == [(money("3150.25"), money("660.00"))]


def test_filter(tables):
    got = ask(tables, "gross_sales", dimensions=["product_category"], filters=[Filter("product_category", "eq", "Nuts")])
    assert rows(got) == [("Nuts", money("1500.00"))]


def test_last_day_of_a_range_is_included(tables):
    def total(start, end):
        return rows(ask(tables, "gross_sales", time_range=TimeRange(start=day(start), end=day(end))))[0][0]

    assert total("2026-01-15", "2026-01-20") == money("1750.25")
    assert total("2026-01-15", "2026-01-19") == money("1000.00")
    assert total("2026-03-01", "2026-03-31") == money("0.00")


def test_preset_needs_no_clock_in_tests(tables):
    got = metric_query(tables, MetricRequest(["gross_sales"], time_range="last_month"), today=day("2026-03-09"))
    assert rows(got) == [(money("1400.00"),)]
    with pytest.raises(UnknownTimeRange):
        ask(tables, "gross_sales", time_range=TimeRange(label="harvest"))


def test_sum_before_join_equals_join_before_sum(tables):
    request = MetricRequest(["gross_sales"], ["customer_name", "product_category"], time_grain="monthly")
    early = metric_query(tables, request)
    late = metric_query(tables, replace(request, options={"all_joins": True}))
    assert rows(early) == rows(late)
    filtered = replace(request, filters=[Filter("customer_name", "is_null")])
    assert rows(metric_query(tables, filtered)) == rows(metric_query(tables, replace(filtered, options={"all_joins": True})))


def test_sort_after_merge_and_limit(tables):
    got = ask(tables, "gross_sales", "total_expenses", time_grain="monthly", order_by=[Sort("total_expenses")], limit=1)
    assert [tuple(r) for r in got.collect()] == [(FEB, money("1400.00"), money("300.00"))]


def test_summary_metrics(tables):
    got = rows(ask(tables, "net_sales", "gross_business_margin", time_grain="monthly"))
    assert got == [(JAN, money("1750.25"), money("1750.25")), (FEB, money("1400.00"), money("1400.00")), (MAR, money("0.00"), money("0.00"))]


def test_daily_summary_has_every_day(tables):
    summary = compose_view(tables, SUMMARY)
    assert summary.count() == 90
    row = summary.where("date_key = 20260105").first()
    assert (row.total_expenses, row.operating_result, row.total_orders) == (money("300.00"), money("-300.00"), 0)


def test_null_sum_without_zero_fill(spark):
    tables = golden_tables(spark)
    registry = standard_registry()
    registry.add(Metric("raw_sales", "v_sales", "sum", "gross_sales", zero_if_no_data=False))
    none = MetricRequest(["raw_sales"], time_range=TimeRange(start=MAR, end=MAR))
    assert rows(metric_query(tables, none, registry)) == [(None,)]
    assert rows(metric_query(tables, replace(none, metrics=["gross_sales"]), registry)) == [(money("0.00"),)]


def test_ratio(spark, tables):
    registry = standard_registry()
    registry.add(Metric("sold", "v_sales", "sum", "quantity", ("product_category",)))
    registry.add(Metric("price", "v_sales", "ratio", None, ("product_category",), numerator="gross_sales", denominator="sold"))
    got = metric_query(tables, MetricRequest(["price"], ["product_category"]), registry)
    assert [(c, v.quantize(Decimal("0.01"))) for c, v in rows(got)] == [("Nuts", money("375.00")), ("Snacks", money("412.56"))]
    nothing = metric_query(tables, MetricRequest(["price"], time_range=TimeRange(start=MAR, end=MAR)), registry)
    assert rows(nothing) == [(None,)]


def test_period_comparison(tables):
    feb = TimeRange(start=FEB, end=day("2026-02-28"))
    got = compare_periods(tables, MetricRequest(["total_expenses"], ["expense_category"], time_range=feb), "previous_period")
    # the 28 days before: 4 to 31 January
    assert rows(got) == [("Rent", money("300.00"), money("300.00")), ("Utilities", money("0.00"), money("60.00"))]
    with pytest.raises(InvalidRequest):
        compare_periods(tables, MetricRequest(["total_expenses"]), "previous_period")
    with pytest.raises(InvalidRequest):
        compare_periods(tables, MetricRequest(["total_expenses"], time_range=feb), "last_decade")


def test_tenant(tables):
    owned = {"view_tenant": "a", "require_tenant": True}
    assert rows(ask(tables, "total_expenses", tenant_id="a", options=owned)) == [(money("660.00"),)]
    assert rows(ask(tables, "total_expenses", tenant_id="b", options=owned)) == [(money("0.00"),)]
    with pytest.raises(InvalidRequest):
        ask(tables, "total_expenses", options=owned)
    assert for_tenant(compose_view(tables, "v_expenses", ["amount"]), "a").columns == ["tenant_id", "amount"]


@pytest.mark.parametrize(
    "kw",
    [
        {"metrics": []}, {"metrics": ["nope"]}, {"metrics": ["gross_sales"], "dimensions": ["order_status"]},
        {"metrics": ["gross_sales"], "dimensions": ["product_id", "product_id"]}, {"metrics": ["gross_sales", "gross_sales"]},
        {"metrics": ["gross_sales"], "time_grain": "hourly"}, {"metrics": ["gross_sales"], "limit": 0},
        {"metrics": ["gross_sales"], "limit": True}, {"metrics": ["gross_sales"], "row_cap": -1},
        {"metrics": ["gross_sales"], "order_by": [Sort("period")]},
        {"metrics": ["gross_sales", "total_expenses"], "filters": [Filter("product_category", "eq", "Nuts")]},
        {"metrics": ["gross_sales"], "filters": [Filter("product_id; drop", "eq", "x")]},
        {"metrics": ["gross_sales"], "filters": [Filter("product_id", "in", [])]},
        {"metrics": ["gross_sales"], "filters": [Filter("product_id", "between", ["a"])]},
        {"metrics": ["gross_sales"], "filters": [Filter("product_id", "is_null", "x")]},
        {"metrics": ["gross_sales"], "filters": [Filter("product_id", "eq")]},
        {"metrics": ["gross_sales"], "filters": [Filter("product_id", "similar", "x")]},
    ],
)
def test_requests_that_cannot_run(tables, kw):
    with pytest.raises(InvalidRequest):
        metric_query(tables, MetricRequest(**kw))


def test_strategy():
    r = standard_registry()
    assert strategy([r["cash_in"]]) == "none"
    assert strategy([r["return_amount"], r["cash_refund"]]) == "none"
    assert strategy([r["cash_in"], r["cash_out"]]) == "split_metrics"
    assert strategy([r["cash_in"], r["gross_sales"]]) == "side_by_side"
    assert strategy([r["cash_in"], r["gross_sales"]], compare=True) == "compare_metrics"


def test_registry():
    r = standard_registry()
    assert len(r) == 18
    assert all(not r.problems_of(m) for m in r.values())
    with pytest.raises(UnknownMetric):
        r["nope"]
    for bad in (Metric("a", "v_sales", "median", "gross_sales"), Metric("a", "v_none", "sum", "x"),
                Metric("a", "v_sales", "sum", "no_column"), Metric("a", "v_sales", "ratio", None, numerator="x", denominator="y")):
        with pytest.raises(ValueError):
            r.add(bad)


def test_request_in_business_terms(spark, tables):
    said = MetricRequest(["Revenue"], ["branch", "Product Category"], [Filter("store", "eq", "shop"), Filter("category", "ne", "Jam")])
    request = resolve_request(spark, tables, said)
    assert (request.metrics, request.dimensions) == (["gross_sales"], ["location_name", "product_category"])
    assert request.filters == [Filter("location_id", "eq", "L1"), Filter("product_category", "ne", "Jam")]
    assert rows(metric_query(tables, request)) == [("Shop", "Nuts", money("1500.00")), ("Shop", "Snacks", money("1650.25"))]


def test_every_open_term_is_reported(spark, tables):
    with pytest.raises(UnresolvedTerms) as unknown:
        resolve_request(spark, tables, MetricRequest(["earn", "gross sales", "magic"], ["weather"]))
    assert unknown.value.issues == [("metric", "earn", "ambiguous"), ("metric", "magic", "not_found")]
    with pytest.raises(UnresolvedTerms) as later:
        resolve_request(
            spark, tables, MetricRequest(["sales"], ["weather", "vendor"], [Filter("branch", "in", ["shop", "moon"]), Filter("mood", "eq", 1)])
        )
    assert later.value.issues == [
        ("dimension", "weather", "not_found"), ("dimension", "vendor", "invalid"), ("filter", "mood", "not_found"),
        ("filter value", "moon", "not_found"),
    ]


# plans ------------------------------------------------------------------------------------


def test_unneeded_dimensions_are_not_joined_and_dates_reach_the_scan(spark, tables, tmp_path):
    stored = dict(tables)
    for name in ("fact_sales", "dim_product"):
        tables[name].write.parquet(str(tmp_path / name))
        stored[name] = spark.read.parquet(str(tmp_path / name))
    df = metric_query(stored, MetricRequest(["gross_sales"], ["location_id"], time_range=TimeRange(start=JAN, end=FEB)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1  # the location only
    assert "GreaterThanOrEqual(date_key,20260101)" in plan and "LessThanOrEqual(date_key,20260201)" in plan
    scan = [line for line in plan.splitlines() if "FileScan" in line and "gross_sales" in line][0]
    assert "order_item_id" not in scan and "product_key" not in scan
    total = metric_query(stored, MetricRequest(["gross_sales"], time_grain="monthly"))
    assert "Join" not in total._jdf.queryExecution().executedPlan().toString()


def test_one_scan_for_metrics_of_one_view(tables):
    df = ask(tables, "cash_in", "cash_out", time_grain="monthly")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_views_know_their_columns(tables):
    assert len(VIEWS) == 10
    with pytest.raises(ValueError):
        compose_view(tables, "v_sales", ["colour"])
    both = [rows(compose_view(tables, "v_sales", ["order_item_id", "sale_date", "product_key"], all_joins=j)) for j in (False, True)]
    assert both[0] == both[1]
