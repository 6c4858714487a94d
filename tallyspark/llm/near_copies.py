"""Near copies: documents with a Jaccard similarity of their distinct word shingles of at least a given share.

Candidates are documents whose SimHashes of their distinct words differ in at most RADIUS bits, found by the
pigeonring keys of ``simhash``. Words that change in many places move a SimHash further, so documents that agree in
all ROWS MinHashes of one of BANDS bands are candidates as well. That depends on the similarity
only, wherever and however the texts differ: of pairs at a similarity s, (1 - s ** ROWS) ** BANDS are not in
it, 5 of 100,000 at 0.8 and fewer above. A candidate's parities (of the numbers of hashes in each of
PARITIES buckets) differ in at most as many places as the sets have hashes that only one of them holds, so those that
differ in more than the similarity allows are dropped without loss. The rest is verified on the whole sets
of shingle hashes, so no pair below the similarity is ever linked.

Equal sets are one node of the graph of links. Nodes are first compared with the first and the last node of
each of their keys; the join of all nodes of a key then looks only at pairs that this has not connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.llm import common, simhash, words
from tallyspark.llm.components import components

BANDS, ROWS = 25, 5
#: Bits in which SimHashes of candidates may differ.
RADIUS = 3
#: Odd factors: the least product of a set's hashes with each is one MinHash.
FACTORS = words.mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64), 1) | np.uint64(1)
#: Buckets whose parities are kept, 64 to a number.
PARITIES = 1024
#: Hashes that are multiplied at a time.
AT_ONCE = 1 << 10


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of the shingles of the whole text, sorted; of fewer words than a shingle, the hash of all of them."""
    known = np.zeros(0, np.uint64)
    for pieces in words.shingle_blocks(words.lowered(text), shingle):
        known = np.union1d(known, words.hashes(pieces))
    return known


def band_keys(own: np.ndarray) -> np.ndarray:
    """The hash of the MinHashes of each band; none for the empty set."""
    if not len(own):
        return np.zeros(0, np.uint64)
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(own), AT_ONCE):
        np.minimum(least, (own[low : low + AT_ONCE, None] * FACTORS).min(axis=0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for n, column in enumerate(least.reshape(BANDS, ROWS).T):
        keys = words.mixed(keys + column, n + 1)
    return keys


def parities(own: np.ndarray) -> np.ndarray:
    odd = np.bincount((own % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def sketches(text: Column, shingle: int) -> Column:
    """Array of the size of the shingle set, two halves of its digest, the SimHash of the words, the parities and the band keys."""
    def of(text: str | None) -> np.ndarray:
        own = shingle_set(text, shingle)
        digest = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.uint64)
        print_ = simhash.fingerprints(text, 1, distinct=True)
        return np.concatenate([np.array([len(own)], np.uint64), digest, print_, parities(own), band_keys(own)]).view(np.int64)

    @F.pandas_udf("array<long>")
    def sketch(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([of(t) for t in batch])

    return sketch(text.cast("string"))


def shingle_sets(text: Column, shingle: int) -> Column:
    @F.pandas_udf("array<long>")
    def sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shingle_set(t, shingle).view(np.int64) for t in batch])

    return sets(text.cast("string"))


def index(groups: DataFrame) -> DataFrame:
    """Rows (key, node, ring) of keys that several nodes share, with the first and the last of those; ``groups``: node, keys, print.

    Keys of SimHashes have the turned SimHash as ring, those of bands have none. No print: no such keys.
    """
    of_bands = F.transform("keys", lambda k: F.struct(k.alias("key"), F.lit(None).cast("long").alias("ring")))
    of_print = F.when(F.col("print").isNull(), F.array().cast("array<struct<key:bigint,ring:bigint>>")).otherwise(
        simhash.chain_keys(F.lit(0), F.col("print"), RADIUS)
    )
    rows = groups.select("node", F.explode(F.concat(of_bands, of_print)).alias("k")).select("node", "k.key", "k.ring")
    of_key = W.partitionBy("key")
    place = F.struct("node", "ring")
    return common.cut(
        rows.select("*", F.min(place).over(of_key).alias("low"), F.max(place).over(of_key).alias("high")).where("low.node < high.node")
    )


def may_be(one: str, other: str, least: float) -> Column:
    """Whether sets of these sizes and parities can have the similarity at all."""
    sizes = F.col(f"{one}.size"), F.col(f"{other}.size")
    apart = [F.bit_count(F.get(f"{one}.odd", F.lit(n)).bitwiseXOR(F.get(f"{other}.odd", F.lit(n)))) for n in range(PARITIES // 64)]
    # a similarity s leaves (1 - s) / (1 + s) of both sizes unshared
    allowed = (sizes[0] + sizes[1]) * ((1 - least) / (1 + least)) + 1e-6
    return (F.least(*sizes) / F.greatest(*sizes) >= least) & (sum(apart[1:], apart[0]) <= allowed)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs a, b whose shingle sets (``sets``: node, own) have at least this Jaccard similarity."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("own").alias(f"own_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("shared", F.size(F.array_intersect("own_a", "own_b")))
    return both.where(F.col("shared") / (F.size("own_a") + F.size("own_b") - F.col("shared")) >= least).select("a", "b")


def star_pairs(indexed: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Every node with the first and the last node of its keys, where they may be copies; ``nodes``: node, size, odd."""
    to = lambda end: indexed.where(
        (F.col("node") != F.col(f"{end}.node"))
        & F.coalesce(F.bit_count(F.col("ring").bitwiseXOR(F.col(f"{end}.ring"))) <= RADIUS, F.lit(True))
    ).select(F.col("node").alias("a"), F.col(f"{end}.node").alias("b"))
    ends = to("low").union(to("high")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    both = ends.join(nodes.alias("one"), F.col("a") == F.col("one.node")).join(nodes.alias("other"), F.col("b") == F.col("other.node"))
    return both.where(may_be("one", "other", least)).select("a", "b")


def pairs_between(indexed: DataFrame, nodes: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """The pairs of nodes that share a key, may be copies and have unequal ``roots`` (node, root)."""
    rows = indexed.select("key", "node", "ring").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_key = W.partitionBy("key")
    is_open = F.min("root").over(of_key) < F.max("root").over(of_key)
    rows = common.cut(rows.select("*", is_open.alias("open")).where("open").drop("open").join(nodes, "node"))
    # no ring: a key of a band
    near = F.coalesce(simhash.chains_hold(F.col("one.ring").bitwiseXOR(F.col("other.ring")), RADIUS), F.lit(True))
    return rows.alias("one").join(
        rows.alias("other"), (F.col("one.key") == F.col("other.key")) & (F.col("one.node") > F.col("other.node"))
        & (F.col("one.root") != F.col("other.root")) & near & may_be("one", "other", least),
    ).select(F.col("one.node").alias("a"), F.col("other.node").alias("b")).distinct()


def near_groups(
    docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, least: float = 0.8,
) -> DataFrame:
    """One row per row of ``docs``: key, id, component_id, stays.

    Documents are linked if the Jaccard similarity of their shingle sets is at least ``least``, and grouped by
    chains of links. component_id is the smallest id of the group, and the row with that id, of equal
    ids the first row, stays. Null ids come after all others; a group of null ids has a null one. Null, empty and
    blank texts have the empty set, and are copies of each other only. An empty table gives no rows.
    """
    text = F.col(f"`{text_column}`")
    sketched = common.cut(docs.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{id_column}`").alias("id"), sketches(text, shingle).alias("sketch")
    ).select("key", "id", F.slice("sketch", 1, 3).alias("digest"), F.get("sketch", F.lit(3)).alias("print"),
             F.slice("sketch", 5, PARITIES // 64).alias("odd"), F.slice("sketch", 5 + PARITIES // 64, BANDS).alias("keys")))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("first")
    groups = common.cut(
        sketched.groupBy("digest").agg(
            first, F.first("odd").alias("odd"), F.first("keys").alias("keys"),
            # the empty set is a copy of itself only
            F.first(F.when(F.get("digest", F.lit(0)) > 0, F.col("print"))).alias("print"),
        ).withColumn("node", F.monotonically_increasing_id())
    )
    indexed = index(groups.select("node", "keys", "print"))
    nodes = groups.select("node", F.get("digest", F.lit(0)).alias("size"), "odd")
    compared = indexed.select("node").distinct().join(groups.select("node", "first.key"), "node")
    held = docs.select(F.col(f"`{key}`").alias("key"), text.alias("text")).join(compared.hint("shuffle_hash"), "key")
    sets = common.cut(held.select("node", shingle_sets(F.col("text"), shingle).alias("own")))
    starred = common.cut(components(verified(star_pairs(indexed, nodes, least), sets, least)))
    more = verified(pairs_between(indexed, nodes, starred, least), sets, least)
    roots = common.cut(components(more.union(starred.select(F.col("node").alias("a"), F.col("root").alias("b")))))
    members = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = members.groupBy("root").agg(F.min("first").alias("of_component"))
    of_digest = members.join(of_root, "root").select("digest", "of_component")
    return sketched.join(of_digest, "digest").select(
        "key", "id", F.col("of_component.id").alias("component_id"), (F.col("of_component.key") == F.col("key")).alias("stays")
    )


def without_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of ``near_groups``, the one with the smallest id."""
    keyed, key = common.row_keyed(docs)
    kept = near_groups(keyed, key, id_column, text_column, **options).where("stays").select(F.col("key").alias(key))
    return common.with_kept_rows(keyed, kept, key)
