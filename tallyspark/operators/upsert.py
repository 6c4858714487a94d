"""Surrogate keys and type-1 upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.joins import missing_from

KEY_BUCKET_DIGITS = 3  # hex digits of md5
KEY_BUCKETS = 16**KEY_BUCKET_DIGITS


def assign_keys(
    new_rows: DataFrame, business_key: Sequence[str | Column], key_column: str, existing: DataFrame | None = None, whole: bool = False
) -> DataFrame:
    """Give each new row a dense long key that continues after ``existing``.

    Rows are numbered inside 4096 buckets of the hashed business key and each
    bucket starts where the one before ends, so no task sees all rows. The
    number depends on the data alone: a retried task gives the same keys. The
    bucket starts are one array of 4096 numbers, whatever the table size; as a
    scalar they leave Spark's size estimate of the table alone, which a join
    would multiply, so that a small table is still broadcast later on.

    The rows are worked out twice, the second time only the columns the count
    of the buckets needs. ``whole`` is for rows that come from joins and are
    used with most of their columns: they travel as one struct, of which
    nothing is pruned, so the count and every reader share one shuffle. Their
    starts are joined and no scalar: a subquery is planned apart while it
    runs, by sizes known at other times, and then shares no shuffle. A part of
    the key may also be an expression of the columns.
    """
    text_key = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in business_key])
    hashed = F.conv(F.substring(F.md5(text_key), 1, KEY_BUCKET_DIGITS), 16, 10).cast("int")
    # the hash is never NULL; said openly, it spares the join below a filter that would work it out once more
    bucket = F.coalesce(F.col("__hash"), F.lit(0)).alias("__bucket")
    if whole:
        # a row that may be NULL, as far as the optimizer knows, is not pruned from the count
        row = F.when(F.col("__hash").isNotNull(), F.struct(*new_rows.columns)).alias("__row")
        bucketed = new_rows.withColumn("__hash", hashed).select(bucket, row).repartition("__bucket")
    else:
        bucketed = new_rows.withColumn("__hash", hashed).select(*new_rows.columns, bucket)
    counted = F.count("__row") if whole else F.count("*")
    order = [*business_key, "__row"] if whole else business_key

    sizes = bucketed.groupBy("__bucket").agg(counted.alias("__n"))
    every = new_rows.sparkSession.range(0, KEY_BUCKETS, 1, 1).select(F.col("id").cast("int").alias("__bucket"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = every.join(sizes, "__bucket", "left").select(
        "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    inside = Window.partitionBy("__bucket").orderBy(*order)
    if whole:
        rows = bucketed.select("__bucket", "__row", "__row.*").withColumn("__inside", F.row_number().over(inside))
        numbered = rows.join(F.broadcast(starts), "__bucket")  # every bucket has a start
        first = F.col("__start")
    else:
        in_order = F.array_sort(F.collect_list(F.struct("__bucket", "__start")))
        offsets = starts.agg(F.transform(in_order, lambda s: s["__start"]).alias("starts")).scalar()
        numbered = bucketed.withColumn("__inside", F.row_number().over(inside))
        first = F.element_at(offsets, F.col("__bucket") + 1)
    if existing is not None:
        first = first + existing.agg(F.coalesce(F.max(key_column), F.lit(0))).scalar()
    return numbered.select((F.col("__inside") + first).cast("bigint").alias(key_column), *new_rows.columns)


def keyed_rows(
    existing: DataFrame | None, incoming: DataFrame, business_key: Sequence[str], key_column: str
) -> DataFrame:
    """``incoming`` with surrogate keys: known rows keep theirs, new rows continue the count.

    Known keys are looked up and new ones numbered on the key columns alone; whole rows meet their numbers in one
    join at the end. ``incoming`` is read three times, so it should be stored. Rows that share a key share a number.
    """
    keys = list(business_key)
    asked = incoming.select(*keys).distinct()
    if existing is None:
        numbers = assign_keys(asked, keys, key_column)
    else:
        known = existing.select(key_column, *keys).join(asked, keys, "left_semi").select(key_column, *keys)
        numbers = assign_keys(missing_from(asked, existing, keys), keys, key_column, existing).unionByName(known)
    numbers = numbers.select(key_column, *[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]
    return incoming.join(numbers, same).select(key_column, *incoming.columns)


def upsert(
    existing: DataFrame | None,
    incoming: DataFrame,
    business_key: Sequence[str],
    key_column: str,
    insert_only: dict[str, Column] | None = None,
) -> DataFrame:
    """Insert new keys, overwrite the other columns of known keys.

    Surrogate keys of known rows stay. ``insert_only`` columns get their value
    when a row is first inserted and are kept afterwards.
    """
    insert_only = insert_only or {}
    keys = list(business_key)
    fresh_values = [c.alias(n) for n, c in insert_only.items()]
    if existing is None:
        return assign_keys(incoming.select("*", *fresh_values), keys, key_column)
    columns = existing.columns
    updated = incoming.join(existing.select(*keys, key_column, *insert_only), keys, "inner")
    fresh = missing_from(incoming, existing, keys).select("*", *fresh_values)
    inserted = assign_keys(fresh, keys, key_column, existing)
    # the load is the smaller side of this anti join, so it is the one broadcast
    untouched = existing.join(incoming.select(*keys), keys, "left_anti")
    return untouched.select(*columns).unionByName(updated.select(*columns)).unionByName(inserted.select(*columns))
