"""What a registered query is, and helpers to state one together with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.plans.tpch_warehouse import TpchWarehouse

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    name: str
    build: Build
    sql: str | None = None


REGISTRY: dict[str, Registered] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that both engines print one value alike."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def register(name: str, build: Build, sql: str | None = None) -> None:
    if name in REGISTRY:
        raise ValueError(f"query registered twice: {name}")

    def in_utc(spark: SparkSession, folder: str) -> DataFrame:
        # DuckDB reads timestamps without a zone
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return comparable(build(spark, folder))

    REGISTRY[name] = Registered(name, in_utc, sql)


def on_warehouse(plan: Callable[[TpchWarehouse], DataFrame], together: bool = False) -> Build:
    return lambda spark, folder: plan(TpchWarehouse(spark, folder, together))


def table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def doubles(columns: str, *plain: str) -> str:
    """SELECT list: ``columns`` cast to DOUBLE under their names, ``plain`` as they are."""
    return ", ".join([*plain, *[f"CAST({c} AS DOUBLE) AS {c}" for c in columns.split()]])
