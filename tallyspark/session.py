"""Session settings the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE splits skewed shuffle partitions, coalesces small ones and turns a
# shuffle join into a broadcast join when the measured side is small.
# Broadcasts stay below the byte bound; above it Spark shuffles both sides.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # the JVM never compiles a method above 8000 bytes; Spark then splits wide projections instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app_name: str = "tallyspark", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the engine settings; ``conf`` overrides win."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
