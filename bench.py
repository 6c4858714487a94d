"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Loads and
checks run on the source tables; metric questions run on a warehouse written
once, as they would in use. Every time is the better of two runs.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid

from tallyspark.plans.facts import FACTS
from tallyspark.plans.metric_query import Filter, MetricRequest, Sort, metric_query
from tallyspark.plans.timeranges import TimeRange
from tallyspark.plans.tpch_warehouse import TpchWarehouse
from tallyspark.plans.views import SUMMARY, compose_view
from tallyspark.plans.warehouse_jobs import DIMENSION_ORDER, StoredTables
from tallyspark.registered.catalog import REGISTRY
from tallyspark.session import build_session
from tallyspark.sources.tables import MONTH, TableStore

FROM_SOURCES = (
    "latest_row_dedupe", "fact_orders_load", "fact_sales_load", "fact_returns_load", "fact_purchases_load",
    "fact_stock_movements_load", "fact_upsert", "flagship_top_months", "validate_order", "parse_date_b", "parse_amount",
    "row_hash", "hash_dedupe", "dq_duplicates", "dq_orphans", "reconciliation", "sales_join_hot_keys", "eval_breakdown",
)


def questions() -> dict:
    import datetime as dt

    year = TimeRange(start=dt.date(1997, 1, 1), end=dt.date(1997, 12, 31))
    return {
        "ask_sales_by_category_monthly": MetricRequest(["gross_sales"], ["product_category"], time_grain="monthly"),
        "ask_sales_of_one_year": MetricRequest(["gross_sales"], ["location_name"], time_range=year),
        "ask_top_customers": MetricRequest(
            ["gross_sales"], ["customer_name"], order_by=[Sort("gross_sales", True), Sort("customer_name")], limit=10
        ),
        "ask_filtered_sales": MetricRequest(
            ["gross_sales"], ["product_name"], [Filter("product_category", "in", ["PROMO", "SMALL"])]
        ),
        "ask_stock_in_and_out": MetricRequest(["stock_in_quantity", "stock_out_quantity"], ["product_name"]),
        "ask_returns_four_metrics": MetricRequest(
            ["total_returns", "return_amount", "cash_refund", "due_adjustment"], ["return_type"], time_grain="monthly"
        ),
        "ask_sales_orders_payments": MetricRequest(["gross_sales", "number_of_orders", "total_payments"], ["customer_name"]),
        "ask_margin_yearly": MetricRequest(["net_sales", "gross_business_margin"], time_grain="yearly"),
    }


def write_warehouse(store: TableStore, source: TpchWarehouse) -> StoredTables:
    from pyspark.sql import functions as F

    written = StoredTables(store)
    for name in ("dim_date", *DIMENSION_ORDER):
        source[name].write.mode("overwrite").parquet(store.path("core", name))
        source._built[name] = written[name]
    for name in FACTS:
        rows = source[name]
        if "date_key" in rows.columns:
            rows = rows.withColumn(MONTH, F.floor(F.col("date_key") / 100).cast("int"))
            rows.repartition(MONTH).write.mode("overwrite").partitionBy(MONTH).parquet(store.path("core", name))
        else:
            rows.write.mode("overwrite").parquet(store.path("core", name))
        source._built[name] = written[name]
    return written


def timed(build) -> float:
    best = float("inf")
    for _ in range(2):
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def shared_folder(spark) -> str:
    """BENCH_STORE or the checkpoint folder; a local session, whose tasks see local files, may use a temporary one."""
    named = os.environ.get("BENCH_STORE") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise SystemExit("name a folder that all executors see in BENCH_STORE")
    return tempfile.gettempdir()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cpus,
           "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    for name in FROM_SOURCES:
        times[name] = timed(lambda n=name: REGISTRY[n].build(spark, folder))

    start = time.perf_counter()
    store = TableStore(spark, f"{shared_folder(spark)}/bench-{uuid.uuid4()}")
    tables = write_warehouse(store, TpchWarehouse(spark, folder))
    times["write_warehouse"] = round(time.perf_counter() - start, 3)
    for name, request in questions().items():
        times[name] = timed(lambda r=request: metric_query(tables, r))
    times["daily_business_summary"] = timed(lambda: compose_view(tables, SUMMARY))

    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
