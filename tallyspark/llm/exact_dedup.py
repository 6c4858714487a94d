"""Exact duplicates by digest, with the frequent digests split off before the shuffle.

A Misra-Gries summary (Spark's frequent-items sketch, one per group of tasks, then merged) names every
digest that holds more than ``HOT_SHARE`` of the rows. Their exact group sizes and winners come from a
partially aggregated group-by, and the winners, a table of bounded length, are broadcast: rows of
frequent digests are decided where they are read. Rows of all other digests meet in an ordinary shuffle,
in groups of at most ``HOT_SHARE`` of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.llm import common

#: Counters of the summary. It misses no digest above 3.5 / 2^15 of the rows, where 2^15 is the size of its map.
COUNTERS = 16_384
#: A digest with at least this share of the rows is frequent; so there are at most 1 / (HOT_SHARE - 3.5 / 2^15) of them.
HOT_SHARE = 5e-4
MOST_HOT = 4_096
#: Summaries are merged in two steps, so that no task merges one for each task of the scan.
MERGE_GROUPS = 64


def without_white(text: Column) -> Column:
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), common.WHITE, text)


def frequent_digests(prints: DataFrame) -> DataFrame:
    """digest of every frequent digest, at most MOST_HOT rows. Estimates are never too low, so none is missed."""
    parts = prints.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(digest, {COUNTERS})").alias("summary"), F.count("*").alias("n")
    )
    # grouped by a value that is the same for all: without a group, tasks that got no summary would add one of no type
    merged = parts.groupBy((F.col("part") >= 0).alias("all")).agg(
        F.expr(f"approx_top_k_combine(summary, {COUNTERS})").alias("summary"), F.sum("n").alias("n")
    )
    return (
        merged.select("n", F.explode(F.expr(f"approx_top_k_estimate(summary, {MOST_HOT})")).alias("top"))
        .where((F.col("top.count") > 1) & (F.col("top.count") >= F.col("n") * HOT_SHARE))
        .select(F.col("top.item").alias("digest"))
    )


def decide(docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``, which has a row key in column ``key``: key, id, keep_id, group_size, kept, digest.

    Texts are equal when they are identical without white space; null counts as empty, so all null, empty
    and blank texts form one group. Of equal texts the one with the most code points stays, then the one
    with the smallest id, a null id after all others, then the first row: repeated rows leave one. Texts
    are read whole. An empty table gives no rows. Other columns are not looked at.
    """
    text = common.text_of(text_column)
    prints = common.cut(docs.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{id_column}`").alias("id"),
        (-F.length(text)).alias("shorter"), F.sha2(without_white(text), 256).alias("digest"),
    ))
    place = F.struct("shorter", F.col("id").isNull().alias("no_id"), "id", "key")
    winners = common.cut(
        prints.join(F.broadcast(frequent_digests(prints)), "digest")
        .groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("group_size"))
    )
    hot = F.broadcast(winners)
    own = W.partitionBy("digest")
    frequent = prints.join(hot, "digest").select(*prints.columns, "first", "group_size")
    ordinary = prints.join(hot, "digest", "left_anti").select(
        *prints.columns, F.min(place).over(own).alias("first"), F.count("*").over(own).alias("group_size")
    )
    return frequent.unionByName(ordinary).select(
        "key", "id", F.col("first.id").alias("keep_id"), "group_size",
        (F.col("first.key") == F.col("key")).alias("kept"), "digest",
    )


def without_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; which one, and all odd cases, as in ``decide``."""
    keyed, key = common.row_keyed(docs)
    kept = decide(keyed, key, id_column, text_column).where("kept").select(F.col("key").alias(key))
    return common.with_kept_rows(keyed, kept, key)


def op2(spark: SparkSession, folder: str) -> DataFrame:
    keyed, key = common.row_keyed(common.table(spark, folder, "documents"))
    return decide(keyed, key).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
), g AS (
  SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY h) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""
