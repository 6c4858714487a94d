"""A Merkle manifest of a table: leaf hashes, a tree per group, a tree over the groups, and proofs.

Nodes of a group are numbered from 0 in order. On level j a node is the row of its first leaf, so with a
fan-out of k the nodes of a level stand k^j rows apart: lag and lead columns at fixed offsets d * k^j,
masked by the slot of the node among its siblings and by the length of the run, hold the siblings, and rows
in slot 0 hash their parent. The last run of a level may be shorter; even one node alone gets a parent
while its group has several nodes.

Windows never span a whole group. A pass takes blocks of k^LEVELS consecutive nodes, each a window
partition of bounded length, and climbs LEVELS levels; the block roots are the nodes of the next pass. Proofs
go down the same way, each pass joined to the one above by group and block. Numbers come from a sort by ranges
and the counts of its partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.llm import common

FAN_OUT = 2
#: Most nodes in a window partition; a pass climbs as many levels as fit.
BLOCK = 1_024
#: One level of a proof: what is joined to a digest on its left and right before it is hashed.
STEP = "struct<before:string,after:string>"


def leaf_hash(values: Sequence[Column]) -> Column:
    """SHA-256 of the values: each ``-`` if null, else its UTF-8 byte count, ``:`` and itself; numbers in decimal."""
    texts = [v.cast("string") for v in values]
    fields = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*fields), 256)


def numbered(nodes: DataFrame, order: Sequence[str], tasks: int | None = None) -> DataFrame:
    """``nodes`` with ``at``, the place from 0 in its ``grp``, and ``count``, the rows of the group.

    ``order`` has to tell all rows of a group apart. Rows are sorted by ranges of group and order, so a hot group is
    spread over many tasks; only the rows per group and task, one number each, go through windows.
    """
    spark = nodes.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid_out = common.cut(
        nodes.repartitionByRange(tasks, "grp", *order).sortWithinPartitions("grp", *order)
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("serial"))
    )
    parts = laid_out.groupBy("grp", "part").agg(F.count("*").alias("n"), F.min("serial").alias("first"))
    own = W.partitionBy("grp")
    before = own.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select(
        "grp", "part", F.sum("n").over(own).alias("count"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
    )
    return (
        laid_out.join(starts, ["grp", "part"]).withColumn("at", F.col("serial") + F.col("shift")).drop("part", "serial", "shift")
    )


def levels_of(fan_out: int) -> int:
    n = 1
    while fan_out ** (n + 1) <= BLOCK:
        n += 1
    return n


def joined(digests: Sequence[Column]) -> Column:
    return F.concat(*[F.coalesce(d, F.lit("")) for d in digests])


def climbed(nodes: DataFrame, fan_out: int) -> tuple[DataFrame, DataFrame]:
    """One pass over nodes (grp, at, count, digest, …): the nodes with their ``steps`` and ``block``, and the block roots."""
    levels = levels_of(fan_out)
    size = fan_out**levels
    rows = nodes.withColumn("block", F.floor(F.col("at") / size)).withColumn("node", F.col("digest"))
    block = W.partitionBy("grp", "block").orderBy("at")
    for level in range(levels):
        apart = fan_out**level
        heads = F.col("at") % apart == 0
        several = F.col("count") > apart
        slot = F.floor(F.col("at") / apart) % fan_out
        earlier = [F.when(slot >= d, F.lag("node", d * apart).over(block)) for d in range(fan_out - 1, 0, -1)]
        later = [F.when(slot + d < fan_out, F.lead("node", d * apart).over(block)) for d in range(1, fan_out)]
        step = F.struct(joined(earlier).alias("before"), joined(later).alias("after"))
        rows = rows.withColumn(f"step{level}", F.when(heads & several, step))
        parent = F.sha2(F.concat("node", f"step{level}.after"), 256)
        rows = rows.withColumn(
            "node", F.when(~several, F.col("node")).when(heads & (slot == 0), parent)
        )
    roots = rows.where(F.col("at") % size == 0).select(
        "grp", F.col("block").alias("at"), F.ceil(F.col("count") / size).alias("count"), F.col("node").alias("digest")
    )
    # the row of a node's first leaf is the last one at or before each of its leaves that has a step of the level
    of_node = [F.last(f"step{n}", True).over(block.rowsBetween(W.unboundedPreceding, 0)) for n in range(levels)]
    steps = F.filter(F.array(*of_node), lambda s: s.isNotNull())
    return rows.select(*[c for c in nodes.columns if c != "count"], "block", steps.alias("steps")), roots


def tree(nodes: DataFrame, fan_out: int) -> tuple[list[DataFrame], DataFrame]:
    """The passes over numbered nodes, from the leaves up, each with steps and block, and the root (grp, digest) of each group."""
    most = nodes.agg(F.max("count")).first()[0] or 0
    passes = []
    size = fan_out ** levels_of(fan_out)
    while True:
        with_steps, roots = climbed(nodes, fan_out)
        passes.append(with_steps)
        nodes = common.cut(roots)
        most = -(-most // size)
        if most <= 1:
            return passes, nodes.select("grp", "digest")


def folded(digest: Column, steps: Column) -> Column:
    """The root that a digest and the steps of its proof give."""
    return F.aggregate(steps, digest, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def proof_hash(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(
    docs: DataFrame, leaf: Column, group_column: str = "lang", order_column: str = "doc_id", other_leaf: Column | None = None,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """One row per row of ``docs``: id, grp, at, leaf, other, subroot, root, proof (levels of ``STEP`` from the leaf up).

    Rows of a group are ordered by ``order_column``, null first, rows of one order value by leaf, equal rows as
    they are stored. Groups are ordered by their UTF-8 bytes, null first; null is a group. ``other_leaf`` is
    carried along as ``other``, to be held against the proof. A table of one row has its leaf for root and an
    empty proof; an empty table gives no rows. Columns that the hashes do not name are not looked at.
    """
    keyed, key = common.row_keyed(docs)
    # a group's name in the order of groups and never null, so that joins and windows share one shuffle
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_column}`").cast("string")), F.lit(""))
    leaves = common.cut(keyed.select(
        name.alias("grp"), F.col(f"`{order_column}`").alias("id"), leaf.alias("digest"),
        (other_leaf if other_leaf is not None else leaf).alias("other"), F.col(key).alias("row"),
    ))
    leaves = common.cut(numbered(leaves, ["id", "digest", "row"]).drop("row"))
    passes, subroots = tree(leaves, fan_out)

    above, root = tree(numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("id"), "digest"), ["id"]), fan_out)
    paths = root.select("grp", F.lit(0).cast("long").alias("block"), F.col("digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
    for nodes in reversed(above):
        paths = down(nodes, paths, ["root"])
    # the path of a subroot belongs to the only node of its group in the topmost pass
    paths = paths.select(F.col("id").alias("grp"), F.lit(0).cast("long").alias("block"), F.col("digest").alias("subroot"), "root", "path")
    for nodes in reversed(passes):
        paths = down(nodes, paths, ["subroot", "root"])
    return paths.select(
        "id", F.when(F.col("grp") != "", F.substr("grp", F.lit(2))).alias("grp"), "at", F.col("digest").alias("leaf"), "other",
        "subroot", "root", F.col("path").alias("proof"),
    )


def down(nodes: DataFrame, paths: DataFrame, carried: Sequence[str]) -> DataFrame:
    """The nodes of a pass with the way from each to the root; a block's rows are bounded, so no key of the join is hot."""
    both = nodes.join(paths.select("grp", "block", F.col("path").alias("rest"), *carried), ["grp", "block"])
    rows = both.withColumn("path", F.concat("steps", "rest"))
    return rows.drop("steps", "rest", "block").withColumn("block", F.col("at"))


def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without a doc_id have no crc32 and are not tampered with."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    values = [F.col(c) for c in columns]
    changed = [F.when(tampered, F.col(c) + 1).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in columns]
    rows = manifest(common.table(spark, folder, "documents"), leaf_hash(values), "lang", "doc_id", leaf_hash(changed))
    rows = rows.withColumn("folded_root", folded(F.col("other"), F.col("proof")))
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_hash(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         n_chars, n_chars + 1 AS n_more
  FROM documents
), leaves AS (
  SELECT doc_id, grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST) - 1 AS place, count(*) OVER (PARTITION BY grp) AS n,
         sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen(n_more::VARCHAR) || ':' || n_more, '-') || tail) AS forged
  FROM d
), nodes AS (
  SELECT 0 AS level, grp, place, n, leaf AS h FROM leaves
  UNION ALL
  SELECT level + 1, grp, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY level, grp, place // 2, n
), subroots AS (
  SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, place, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM upper WHERE n > 1 GROUP BY level, place // 2, n
), crcs AS (
  WITH RECURSIVE table_of AS (
    SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i)
    UNION ALL
    SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM table_of WHERE k < 8
  ), walk AS (
    SELECT doc_id, doc_id::VARCHAR AS s, 1 AS k, 4294967295::BIGINT AS c FROM documents WHERE doc_id IS NOT NULL
    UNION ALL
    SELECT doc_id, s, w.k + 1, xor(w.c >> 8, t.c) FROM walk w JOIN table_of t ON t.k = 8 AND t.byte = xor(w.c & 255, ascii(s[w.k]))
    WHERE w.k <= length(s)
  )
  SELECT doc_id, xor(c, 4294967295) AS crc FROM walk WHERE k = length(s) + 1
), climb AS (
  SELECT doc_id, grp, 0 AS level, place, n, CASE WHEN crc % 7 = 0 THEN forged ELSE leaf END AS acc, '' AS proof FROM leaves LEFT JOIN crcs USING (doc_id)
  UNION ALL
  SELECT c.doc_id, c.grp, c.level + 1, c.place // 2, (c.n + 1) // 2,
         sha256(CASE WHEN c.place % 2 = 1 THEN s.h ELSE '' END || c.acc || CASE WHEN c.place % 2 = 0 THEN coalesce(s.h, '') ELSE '' END),
         c.proof || coalesce(s.h, '')
  FROM climb c LEFT JOIN nodes s ON s.grp = c.grp AND s.level = c.level AND s.place = xor(c.place, 1)
  WHERE c.n > 1
), rest AS (
  SELECT c.doc_id, c.grp, s.place, s.n, 0 AS level, c.acc, c.proof FROM climb c JOIN subroots s USING (grp) WHERE c.n = 1
  UNION ALL
  SELECT c.doc_id, c.grp, c.place // 2, (c.n + 1) // 2, c.level + 1,
         sha256(CASE WHEN c.place % 2 = 1 THEN s.h ELSE '' END || c.acc || CASE WHEN c.place % 2 = 0 THEN coalesce(s.h, '') ELSE '' END),
         c.proof || coalesce(s.h, '')
  FROM rest c LEFT JOIN upper s ON s.level = c.level AND s.place = xor(c.place, 1)
  WHERE c.n > 1
)
SELECT r.doc_id, l.leaf, s.subroot, u.h AS root, sha256(r.proof) AS proof_sha256, r.acc AS folded_root, r.acc = u.h AS verified
FROM rest r JOIN leaves l ON l.doc_id IS NOT DISTINCT FROM r.doc_id AND l.grp = r.grp JOIN subroots s ON s.grp = r.grp JOIN upper u ON u.n = 1
WHERE r.n = 1
"""
