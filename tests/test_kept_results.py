"""Distinct counts from daily states, and results kept by month, against the full computation."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.distinct import bitmaps, distinct_by_bitmap, distinct_by_sketch, sketches, standard_error
from tallyspark.plans import kept_results as kept
from tallyspark.plans import warehouse_jobs as wj
from tallyspark.plans.metric_query import MetricRequest, metric_query
from tallyspark.plans.metrics import Metric, standard_registry
from tallyspark.plans.timeranges import TimeRange
from tallyspark.plans.views import SUMMARY, compose_view
from tallyspark.sources.tables import TableStore
from tests.conftest import rows
from tests.golden import golden_tables
from tests.test_latest_and_keys import plan_of
from tests.test_warehouse_jobs import FILES, write


def test_any_union_of_states_counts_exactly(spark):
    draw = random.Random(2)
    data = [(draw.randrange(30), draw.choice([None, draw.randrange(1, 200_000), 32_768, 32_769, 1])) for _ in range(4_000)]
    df = spark.createDataFrame(data, "day int, key long")
    days = bitmaps(df, "key", ["day"]).cache()
    for low, high in ((0, 29), (3, 4), (7, 7), (28, 40), (50, 60)):
        want = len({k for d, k in data if low <= d <= high and k is not None})
        assert distinct_by_bitmap(days.where(F.col("day").between(low, high)), [], "n").first().n == want
    by_week = rows(distinct_by_bitmap(days.withColumn("week", F.floor(F.col("day") / 7)), ["week"], "n"))
    assert by_week == sorted((w, len({k for d, k in data if d // 7 == w and k is not None})) for w in range(5))


def test_sketches_estimate_within_their_error(spark):
    df = spark.range(200_000).select((F.col("id") % 40).alias("day"), F.concat(F.lit("v"), F.col("id") % 60_000).alias("v"))
    states = sketches(df, "v", ["day"], 12)
    n = distinct_by_sketch(states, [], "n").first().n
    assert abs(n - 60_000) < 4 * standard_error(12) * 60_000
    assert distinct_by_sketch(states.limit(0), [], "n").first().n == 0


def test_approximate_metric(spark):
    registry = standard_registry()
    registry.add(Metric("about_sales", "v_sales", "approx_count_distinct", "order_item_id", ("product_category",)))
    got = metric_query(golden_tables(spark), MetricRequest(["about_sales"], ["product_category"]), registry)
    assert rows(got) == [("Nuts", 2), ("Snacks", 2)]


def test_month_runs():
    day = dt.date
    assert kept.month_runs([]) == []
    assert kept.month_runs([202601, 202512, 202512, 202604]) == [(day(2025, 12, 1), day(2026, 1, 31)), (day(2026, 4, 1), day(2026, 4, 30))]


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("kept")
    store = TableStore(spark, str(base / "store"))
    wj.run_all(store, {e: write(base / "in", e, lines) for e, lines in FILES.items()}, dt.date(2026, 7, 1), dt.date(2026, 12, 31))
    kept.refresh_distinct(store)
    kept.refresh_summary(store)
    return store


def late(store, tmp_path, entity, lines):
    batch = wj.ingest(store, entity, write(tmp_path / f"late-{entity}", entity, lines))
    wj.stage(store, entity, batch)
    return batch


def same_as_full(store):
    tables = wj.StoredTables(store)
    summary = store.read("analytics", "daily_business_summary").drop("load_month")
    assert rows(summary) == rows(compose_view(tables, SUMMARY).select(*summary.columns))
    span = TimeRange(start=dt.date(2026, 8, 1), end=dt.date(2026, 9, 10))
    for metric in kept.DISTINCT_COUNTS:
        full = metric_query(tables, MetricRequest([metric], time_range=span, time_grain="monthly"))
        assert rows(kept.stored_count(store, metric, span, "monthly")) == rows(full)
        assert rows(kept.stored_count(store, metric)) == rows(metric_query(tables, MetricRequest([metric])))


def test_kept_results_follow_late_corrections(spark, loaded, tmp_path):
    store = loaded
    when = "Sat Sep 05 2026 00:00:00 GMT+0600 (Bangladesh Standard Time)"
    later = "Sun Sep 06 2026 00:00:00 GMT+0600 (Bangladesh Standard Time)"
    # O1 moves from August to September, O7 and B7 are new, an expense of August is corrected
    batches = [
        late(store, tmp_path, "order", [f"O1,{when},C1,20,0,0,20,20,0,Delivered,Kim,{later}", f"O7,{when},C2,7,0,0,7,7,0,Delivered,Kim,{later}"]),
        late(store, tmp_path, "purchase", [f"B7,{when},S1,60,0,0,60,60,0,Cash,K1,Kim,Done,,{later}"]),
        late(store, tmp_path, "purchase_item", ["BI7,B7,P1,10,6,0,60,L1", "BI8,B7,P1,1,6,0,6,L1"]),
        late(store, tmp_path, "expense", [f"E1,08/15/2026,,tea,$9.00,,K1,Kim,,Kim,{later}"]),
    ]
    months = wj.load_facts(store, batches=batches)
    assert months["fact_orders"] == {202608, 202609} and months["fact_purchases"] == {202609} and months["fact_payments"] == set()
    kept.refresh_distinct(store, months)
    kept.refresh_summary(store, months)
    same_as_full(store)
    # a load of nothing new touches no month
    months = wj.load_facts(store, ["fact_orders"], batches=batches)
    assert months == {"fact_orders": set()}
    before = store.read("analytics", "distinct_number_of_orders").inputFiles()
    kept.refresh_distinct(store, months)
    kept.refresh_summary(store, months)
    assert store.read("analytics", "distinct_number_of_orders").inputFiles() == before


def test_counts_read_states_of_their_months_only(spark, loaded):
    plan = plan_of(kept.stored_count(loaded, "number_of_orders", TimeRange(start=dt.date(2026, 8, 1), end=dt.date(2026, 8, 31))))
    assert "fact_orders" not in plan and "order_id" not in plan
    assert "PartitionFilters: [" in plan and "load_month" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_plain_months_are_taken_over_without_a_copy(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    old = spark.createDataFrame([("A", 20260115, 1), ("B", 20260215, 2), ("C", 20260315, 3)], "id string, date_key int, key long")
    old.withColumn("load_month", F.floor(F.col("date_key") / 100).cast("int")).write.partitionBy("load_month").parquet(store.path("core", "f"))
    kept_file = sorted(p.name for p in (tmp_path / "core" / "f" / "load_month=202602").glob("*.parquet"))
    for n in range(3):
        load = spark.createDataFrame([("A", 20260115 + n, 0)], "id string, date_key int, amount int").select("id", "date_key")
        store.merge_by_month(load, "core", "f", ["id"], "key")
        assert [r[0] for r in rows(store.read("core", "f").select("id"))] == ["A", "B", "C"]
    assert sorted(p.name for p in (tmp_path / "core" / "f" / "load_month=202602").glob("*.parquet")) == kept_file
    assert not (tmp_path / "core" / "f" / "load_month=202601").exists()
