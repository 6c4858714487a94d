"""Hot keys: what Spark is given to split them, and that it does."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.latest import latest_per_key
from tallyspark.plans.facts import load_sales

CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture()
def no_broadcast(spark):
    old = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_order_with_a_third_of_all_lines_is_split(spark, no_broadcast):
    hot = F.when(F.col("id") % 3 == 0, F.lit("0")).otherwise((F.col("id") % 500).cast("string"))
    items = spark.range(0, 30000, 1, 8).select(
        F.col("id").cast("string").alias("order_item_id"), hot.alias("order_id"), F.lit("P").alias("product_id"),
        F.lit("L").alias("stock_location_id"), F.lit(1).cast("decimal(14,3)").alias("quantity"),
        F.lit(2).cast("decimal(14,2)").alias("unit_price"), *[F.lit(None).cast("decimal(14,2)").alias(c) for c in ("cost_price", "line_amount", "item_discount", "cogs")],
        F.lit("pending").alias("record_status"), *[F.sha2(F.col("id").cast("string"), 256).alias(c) for c in ("source_system", "source_table", "source_row_identifier", "ingestion_batch_id", "source_hash")],
        F.lit(1).alias("source_row_number"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("ingested_at"),
    )
    tables = {
        "stg_order_item": items,
        "fact_orders": spark.range(500).select(F.col("id").cast("string").alias("order_id"), F.lit(20260101).alias("date_key"), F.col("id").alias("customer_key")),
        "dim_product": spark.createDataFrame([(1, "P")], "product_key bigint, product_id string"),
        "dim_location": spark.createDataFrame([(1, "L")], "location_key bigint, stock_location_id string"),
    }
    df = load_sales(tables)
    counted = df.groupBy("order_id").count().orderBy(F.desc("count"))
    assert df.count() == 30000
    df.write.format("noop").mode("overwrite").save()
    assert counted.first()["count"] >= 10000
    written = df.select("order_item_id", "customer_key")
    written.collect()
    assert "skew=true" in written._jdf.queryExecution().executedPlan().toString()


def test_hot_key_leaves_each_map_task_as_one_row(spark):
    rows = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") % 3 != 1, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("at"))
    latest = latest_per_key(rows, ["k"], ["at"])
    assert latest.where("k = 0").first()["at"] == 3999
    latest.collect()
    plan = latest._jdf.queryExecution().executedPlan()
    shuffled = [int(line.split("rowCount=")[1].split(")")[0]) for line in plan.toString().splitlines() if "rowCount=" in line]
    assert all(n <= 1333 + 4 for n in shuffled)
