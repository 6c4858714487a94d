"""Join forms the warehouse needs. No side is broadcast by hint: Spark compares
each side with its byte threshold and shuffles both sides beyond it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_spread_nulls(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, spread_by: str, parts: int | None = None
) -> DataFrame:
    """Left outer join whose NULL-key rows do not meet in one task.

    A NULL key matches nothing, but all NULL-key rows hash to one partition.
    They get a second key part, taken from the row's own id ``spread_by``,
    that the right side never has: one of ``parts``, as many as there are
    shuffle partitions when not given.
    """
    parts = parts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.when(
        F.col(left_key).isNull(), F.pmod(F.xxhash64(spread_by), F.lit(parts)) + 1
    ).otherwise(F.lit(0))
    marked = left.withColumn("__spread", spread)
    keyed = right.withColumn("__right_spread", F.lit(0).cast("bigint"))
    condition = (marked[left_key] == keyed[right_key]) & (marked["__spread"] == keyed["__right_spread"])
    return marked.join(keyed, condition, "left").drop("__spread", "__right_spread")


def missing_from(left: DataFrame, right: DataFrame, keys: Sequence[str], right_keys: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right`` (NULL keys stay).

    When ``left`` is one load and ``right`` is the whole history, the history
    is first cut to the keys of the load: the small key set is what gets
    broadcast or bloom-filtered, and the history is read without a shuffle.
    """
    right_keys = list(right_keys or keys)
    wanted = left.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    history = right.select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(right_keys)])
    on_keys = [F.col(f"__h{i}") == F.col(f"__k{i}") for i in range(len(right_keys))]
    seen = history.join(wanted, on_keys, "left_semi")
    on_left = [left[k] == seen[f"__h{i}"] for i, k in enumerate(keys)]
    return left.join(seen, on_left, "left_anti")


def join_split_hot_keys(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    hot_share: float = 0.01,
    parts: int = 32,
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Inner or left join on ``key`` where few keys hold much of ``left``.

    A key is hot when it holds at least ``hot_share`` of the rows, so there
    are at most ``1 / hot_share`` hot keys, whatever the data size. Rows of a
    hot key on the left are spread over ``parts``; the matching right rows are
    repeated once per part. All other rows join as usual. Exact: every left
    row meets each of its right rows once. ``spread_by`` names columns that
    tell rows of one key apart (all columns when not given).
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    counts = left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("__n"))
    total = left.agg(F.count("*").alias("__total")).scalar()
    hot = counts.where(F.col("__n") >= total * F.lit(hot_share)).select("__hot")
    hot_left = hot.select(F.col("__hot").alias("__hl"))
    hot_right = hot.select(F.col("__hot").alias("__hr"))
    spread = F.pmod(F.xxhash64(*(spread_by or left.columns)), F.lit(parts)).cast("int")
    marked = (
        left.join(F.broadcast(hot_left), left[key] == F.col("__hl"), "left")
        .withColumn(
            "__part",
            F.when(F.col("__hl").isNotNull() | F.col(key).isNull(), spread).otherwise(F.lit(0)),
        )
        .drop("__hl")
    )
    copies = (
        right.join(F.broadcast(hot_right), right[key] == F.col("__hr"), "left")
        .withColumn(
            "__part",
            F.explode(F.when(F.col("__hr").isNotNull(), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))),
        )
        .drop("__hr")
    )
    return marked.join(copies, [key, "__part"], how).drop("__part")
