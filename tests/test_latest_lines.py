"""Latest lines are found on the columns of lineitem: one shuffle for all tables staged from them."""

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.operators.latest import pending_latest
from tallyspark.plans.facts import FACTS
from tallyspark.plans.tpch_warehouse import LINE_STAGING, LINE_VERSION, TpchWarehouse

COLUMNS = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double,"
    " l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
)


def _warehouse(spark, folder):
    day = dt.datetime(2020, 1, 1)
    keys = [(1, 1), (1, 1), (1, 2), (11, 1), (1, None), (None, 1), (None, 1), (None, None), (None, None), (2, None)]
    rows = [
        (o, 7 + i, i, n, 1.0 + i, 2.0, 0.1, None if i % 2 else 0.0, "NAR"[i % 3], "OF"[i % 2], None if i % 4 == 3 else day + dt.timedelta(days=v))
        for v in (0, 1) for i, (o, n) in enumerate(keys)
    ]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/lineitem.parquet")
    return TpchWarehouse(spark, str(folder))


def test_latest_lines_are_those_of_the_staged_rows(spark, tmp_path):
    w = _warehouse(spark, tmp_path)
    key_of = {s.staging: s.staging_key for s in FACTS.values()}
    for staging in LINE_STAGING:
        got, want = w[f"latest_{staging}"], pending_latest(w[staging], [key_of[staging]], LINE_VERSION)
        assert got.columns == want.columns
        assert want.count() and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_tables_of_lines_share_a_shuffle(spark, tmp_path):
    w = _warehouse(spark, tmp_path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sold = w["latest_stg_order_item"].select("order_item_id", "quantity", "cogs")
        both = sold.union(w["latest_stg_purchase_item"].select("purchase_item_id", "quantity", "line_amount"))
        assert "ReusedExchange" in both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_readers_of_other_columns_share_the_shuffle(spark, tmp_path):
    w = _warehouse(spark, tmp_path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        days = w["latest_stg_purchase_item"].groupBy("ingested_at").count()  # asks for no line id
        both = w["latest_stg_order_item"].select("order_item_id", "quantity").union(days.select(F.col("ingested_at").cast("string"), "count"))
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(__key") == 2 and "ReusedExchange [__key" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
