"""Keep one version per business key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Versions are ordered by arrival, then by position in the source, then by content.
VERSION_COLUMNS = ("ingested_at", "source_row_number", "source_hash")


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    version: Sequence[str | Column] = VERSION_COLUMNS,
) -> DataFrame:
    """One row per key: the greatest version, NULL versions lowest.

    ``row_number() = 1`` lets Spark drop all but one row per key inside each
    map task before the shuffle, so a key that holds a large share of the rows
    costs no more than any other. ``version`` has to be a total order within
    a key for the result to be the same on a retried task.
    """
    ordering = [(F.col(v) if isinstance(v, str) else v).desc_nulls_last() for v in version]
    window = Window.partitionBy(*keys).orderBy(*ordering)
    return df.withColumn("__rn", F.row_number().over(window)).where("__rn = 1").drop("__rn")


def latest_of_all_and_some(df: DataFrame, keys: Sequence[str], version: Sequence[str], some: Column) -> tuple[DataFrame, DataFrame]:
    """Two tables from one shuffle: the latest row per key of all rows, and of the rows where ``some`` holds.

    Their columns are the keys and ``version``, which has to be all other columns. The greatest rows are found inside
    each map task before the shuffle, as in ``latest_per_key``.
    """
    row = F.struct(*version)
    heads = df.groupBy(*keys).agg(F.max(row).alias("__last"), F.max(F.when(some, row)).alias("__last_some"))
    # the latest of all is never less; asking for it keeps both tables from pruning the shuffle, each in its own way
    both = F.col("__last") >= F.col("__last_some")
    return (
        heads.where(F.col("__last_some").isNull() | both).select(*keys, "__last.*"),
        heads.where(both).select(*keys, "__last_some.*"),
    )


def pending_latest(
    staged: DataFrame, keys: Sequence[str], version: Sequence[str | Column] = VERSION_COLUMNS
) -> DataFrame:
    """Latest version per key among rows that passed validation."""
    return latest_per_key(staged.where(F.col("record_status") == "pending"), keys, version)
