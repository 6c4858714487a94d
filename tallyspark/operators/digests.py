"""Digests of tables that do not depend on the order of rows: a count, an exact total and a sum of row hashes.

They can be added and taken away, so the digest of a table is the sum of those of its parts, and replacing a row
takes one hash away and adds another. Equal digests mean equal rows, repeated ones counted, up to the chance that
sums of 60-bit hashes meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.latest import VERSION_COLUMNS, latest_per_key

COUNT, TOTAL, DIGEST = "row_count", "total", "digest"
MEASURES = (COUNT, TOTAL, DIGEST)
TOTAL_TYPE, DIGEST_TYPE = "decimal(38,2)", "decimal(38,0)"
HEX_DIGITS = 15  # of the md5: the sum of 10^18 such hashes stays exact


def row_number_of(*columns: Column) -> Column:
    """A row as a number below 2^60; the length before each value keeps values apart, and NULL from a text."""
    told = [F.coalesce(F.concat(F.char_length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(",", *told)), 1, HEX_DIGITS), 16, 10).cast("bigint")


def weighed(weight: Column, key: Column, amount: Column | None = None) -> list[Column]:
    """The three measures of rows that count ``weight`` times: 1 to add a row, -1 to take it away. A NULL amount is 0."""
    value = F.coalesce(amount, F.lit(0)).cast(TOTAL_TYPE) if amount is not None else None
    number = row_number_of(key) if value is None else row_number_of(key, value)
    total = F.lit(None).cast(TOTAL_TYPE) if value is None else F.coalesce(F.sum(weight * value), F.lit(0)).cast(TOTAL_TYPE)
    return [
        F.coalesce(F.sum(weight), F.lit(0)).cast("bigint").alias(COUNT),
        total.alias(TOTAL),
        F.coalesce(F.sum((weight * number).cast("decimal(20,0)")), F.lit(0)).cast(DIGEST_TYPE).alias(DIGEST),
    ]


def digests(rows: DataFrame, key: str, amount: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One digest per group of ``by``, or one in all; added up before the shuffle, which carries a row per group and task."""
    return rows.groupBy(*by).agg(*weighed(F.lit(1), F.col(key), F.col(amount) if amount else None))


def added(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The digests of tables from those of their parts."""
    return parts.groupBy(*by).agg(
        F.coalesce(F.sum(COUNT), F.lit(0)).cast("bigint").alias(COUNT),
        F.sum(TOTAL).cast(TOTAL_TYPE).alias(TOTAL),
        F.coalesce(F.sum(DIGEST), F.lit(0)).cast(DIGEST_TYPE).alias(DIGEST),
    )


def change_of_latest(
    rows: DataFrame, is_new: Column, key: str, amount: str | None = None, version: Sequence[str | Column] = VERSION_COLUMNS
) -> DataFrame:
    """What the new rows change in the digest of the latest row per key.

    Only keys with a new row can change, so the others are left out first. Of a key at most two rows are weighed:
    the latest of all counts for, the latest of the old ones against; if they are one row, nothing changes.
    """
    marked = rows.where(F.col(key).isNotNull()).withColumn("__new", is_new)
    touched = marked.where("__new").select(key).distinct()
    heads = latest_per_key(marked.join(touched, key, "left_semi"), [key, "__new"], version)
    last = latest_per_key(heads, [key], version).withColumn("__weight", F.lit(1))
    before = heads.where(~F.col("__new")).withColumn("__weight", F.lit(-1))
    return last.unionByName(before).agg(*weighed(F.col("__weight"), F.col(key), F.col(amount) if amount else None))
