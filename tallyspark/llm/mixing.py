"""Mixing sources to target weights by systematic sampling.

Within a source every document expects ``target / source size`` copies. The documents stand in a row, the
expected copies are summed along it, one random offset is added, and a document is emitted once for each
whole number its piece of the sum crosses. The row is ordered by size class first, so that the words taken
follow the target closely, and by a hash of the id inside a class.

No source is summed in one task: a document's place is the number of documents in the size classes before,
plus those in the hash buckets before, plus its number in its own bucket. The first two come from tables of
counts with at most CLASSES and BUCKETS rows per group; only the last orders documents, a bucket at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.llm import common

#: A size class is the number of binary digits and the leading five: 32 * 64 classes at most, each 1/16 octave.
CLASSES = 2_048
#: Two hexadecimal digits of the hash.
BUCKETS = 256
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST, SEED = 1.5, 2.0, "mix"


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """Per source: source_key, source_size, target, rate (expected copies), start (the random offset).

    ``sized`` has source, source_key and size. The targets share ``share`` times all words by weight; a
    target above ``most`` times its source stops there and the excess goes to the others by weight. That
    is a common level: in order of the level at which they fill up, sources are full while the level that
    remains for the others is above their own. One row per source passes through one task.
    """
    of_source = sized.groupBy("source_key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    by_code_point = W.orderBy(F.col("source").isNull(), "source")
    weighted = of_source.withColumn("place", F.row_number().over(by_code_point)).withColumn(
        "weight", F.get(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights)).cast("int"))
    ).withColumn("full", F.lit(most) * F.col("source_size"))
    filling = W.orderBy(F.col("full") / F.col("weight"), "place")
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    everywhere = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = weighted.select(
        "*",
        ((F.lit(share) * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("full").over(before), F.lit(0.0)))
         / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"),
    ).withColumn("stops", F.col("level") > F.col("full") / F.col("weight"))
    common_level = F.max(F.when(~F.col("stops"), F.col("level"))).over(everywhere)
    return rest.withColumn("common_level", common_level).select(
        "source_key", "source_size",
        F.when(F.col("stops"), F.col("full")).otherwise(F.col("common_level") * F.col("weight")).alias("target"),
        (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), "source_key")), 1, 8), 16, 10).cast("double")
         / F.lit(4294967296.0)).alias("start"),
    ).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def copies(
    docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED,
) -> DataFrame:
    """One row per row of ``docs``: key, id, size, source_size, target, copies, taken.

    size is the number of words of the whole text, 0 for null. A null source is a source of its own, the
    last one; a null id hashes as an empty one. Rows with equal ids and sizes have neighbouring places.
    Documents of size 0 have places like any other and take no words. An empty table gives no rows, and
    where no text has a word all targets are 0. The result depends on the rows and the seed alone.
    """
    source = F.col(f"`{source_column}`").cast("string")
    sized = common.cut(docs.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{id_column}`").alias("id"), source.alias("source"),
        F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source)).alias("source_key"),
        F.regexp_count(common.text_of(text_column), F.lit(common.WORD)).cast("long").alias("size"),
    ))
    digits = F.length(F.bin("size"))
    placed = sized.select(
        "*", (digits * 32 + F.expr("shiftright(size, greatest(length(bin(size)) - 5, 0))")).cast("int").alias("class"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("id").cast("string"), F.lit("")))).alias("hash"),
    ).withColumn("bucket", F.substring("hash", 1, 2))

    counts = placed.groupBy("source_key", "class", "bucket").agg(F.count("*").alias("n"))
    classes = counts.groupBy("source_key", "class").agg(F.sum("n").alias("n"))
    so_far = lambda *by: W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    class_starts = classes.select(
        "source_key", "class", F.coalesce(F.sum("n").over(so_far("source_key", "class")), F.lit(0)).alias("class_start")
    ).join(source_targets(sized, weights, share, most, seed), "source_key")
    starts = counts.select(
        "source_key", "class", "bucket",
        F.coalesce(F.sum("n").over(so_far("source_key", "class", "bucket")), F.lit(0)).alias("bucket_start"),
    ).join(class_starts, ["source_key", "class"])

    here = W.partitionBy("source_key", "class", "bucket").orderBy("hash", "size", "id", "key")
    crossed = lambda place: F.floor(F.col("rate") * place + F.col("start"))
    return (
        placed.withColumn("number", F.row_number().over(here)).join(starts, ["source_key", "class", "bucket"])
        .withColumn("place", F.col("class_start") + F.col("bucket_start") + F.col("number"))
        .withColumn("copies", crossed(F.col("place")) - crossed(F.col("place") - 1))
        .select("key", "id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, and copy_no, counted from 1 (with underscores if the name is taken)."""
    keyed, key = common.row_keyed(docs)
    number, numbers = common.fresh(docs, "copy_no"), common.fresh(docs, "_copy_numbers")
    taken = copies(keyed, key, id_column, text_column, source_column, **options).where("copies > 0").select(
        F.col("key").alias(key), F.sequence(F.lit(1), F.col("copies").cast("int")).alias(numbers)
    )
    both = keyed.join(taken.hint("shuffle_hash"), key)
    return both.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.explode(numbers).alias(number)
    )


def op7(spark: SparkSession, folder: str) -> DataFrame:
    keyed, key = common.row_keyed(common.table(spark, folder, "documents"))
    return copies(keyed, key).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies"
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s AS (
  SELECT k, min(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k
), w AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS place, 2.0::DOUBLE * source_size AS top FROM s
), v AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM w
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(top) OVER b, 0.0::DOUBLE))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS level
  FROM v WINDOW b AS (ORDER BY top / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT k, source_size,
         CASE WHEN level > top / weight THEN top
              ELSE max(CASE WHEN level <= top / weight THEN level END) OVER () * weight END AS target,
         CAST(CAST('0x' || substr(md5('mix|' || k), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS start
  FROM l
), p AS (
  SELECT d.doc_id, d.size, t.*, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY d.k ORDER BY length(bin(size)) * 32 + (size >> greatest(length(bin(size)) - 5, 0)),
                            h, size, doc_id NULLS FIRST) AS place
  FROM d JOIN t ON d.k = t.k
), c AS (
  SELECT *, CAST(floor(rate * place + start) - floor(rate * (place - 1) + start) AS BIGINT) AS copies FROM p
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, copies * size AS taken, copies FROM c
"""
