"""Connected components of a link table, in rounds of joins (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import cut


#: Links of one task. Rounds over few links take few tasks, however many shuffle partitions there are.
LINKS_PER_TASK = 100_000


def _star(pairs: DataFrame, tasks: int) -> DataFrame:
    """Every neighbour of a node linked to the smallest one; the node itself counts as its neighbour."""
    heads = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("head"))
    return pairs.join(heads, "a").coalesce(tasks)


def components(links: DataFrame) -> DataFrame:
    """node, root: of every node in ``links`` (a, b, both of one type that sorts) the smallest node it reaches.

    Each round hangs nodes on smaller ones; the rounds grow with the logarithm of the longest path. Links
    are kept in the shared folder between rounds and only their number and a sum come to the driver.
    Nodes without links are not listed. Loops and repeated links change nothing.
    """
    larger_first = links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = cut(larger_first.distinct())
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        tasks = max(1, -(-now["n"] // LINKS_PER_TASK))
        edges = edges.coalesce(tasks)
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, tasks).where(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.col("head").alias("b")
        ).distinct().coalesce(tasks)
        small = _star(large, tasks)
        edges = cut(
            small.select("a", F.col("head").alias("b"))
            .union(small.where(F.col("b") != F.col("head")).select(F.col("b").alias("a"), F.col("head").alias("b")))
            .distinct().coalesce(tasks)
        )
