"""Near duplicates by SimHash, with a pigeonring filter.

A fingerprint is a ring of SEGMENTS segments. If two fingerprints differ in at most ``radius`` bits, then
from some segment on, for every length l, the chain of l consecutive segments differs in at most
floor(l * radius / SEGMENTS) bits (pigeonring principle, Qin and Xiao 2018). Chains whose budget is 0 must
be equal, and of the bits that follow while the budget is 1, one half must be. That gives the join key; in
the join's condition the budgets of all longer chains prune what is left, and the last chain, the whole
ring, is the Hamming check. Nothing within the radius is lost, and only true links leave the join, each
at the first of the neighbouring segments it could be found from. Keys of one node only are dropped before.

Equal fingerprints are one node of the graph of links, so copies cost no links. Groups are the connected
components of that graph. Nodes are first linked to the first and the last node of each of their keys; the
join then looks only for links between nodes that this has not connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.llm import common, words
from tallyspark.llm.components import components

BITS, SEGMENTS = 64, 8
WIDTH = BITS // SEGMENTS
#: Hashes whose bits are counted at a time.
AT_ONCE = 1 << 15


def bits_set(hashed: np.ndarray) -> np.ndarray:
    """How many of the hashes set each bit."""
    ones = np.zeros(BITS, np.int64)
    for low in range(0, len(hashed), AT_ONCE):
        some = np.ascontiguousarray(hashed[low : low + AT_ONCE])
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def fingerprints(text: str | None, shingle: int = 3, count: int = 1, distinct: bool = False) -> np.ndarray:
    """``count`` fingerprints of the whole text; the first from XXH64 itself, the others from hashes of it. No word: zeros.

    With ``distinct`` a shingle that repeats counts once.
    """
    ones, total, known = np.zeros((count, BITS), np.int64), 0, np.zeros(0, np.uint64)
    for pieces in words.shingle_blocks(words.lowered(text), shingle):
        h = words.hashes(pieces)
        if distinct:
            h = np.setdiff1d(h, known)
            known = np.union1d(known, h)
        total += len(h)
        for j in range(count):
            ones[j] += bits_set(words.mixed(h, j) if j else h)
    return np.packbits(2 * ones > total, axis=1, bitorder="little").view(np.uint64).ravel()


@dataclass(frozen=True)
class Check:
    """What linked documents must agree in besides: ``count`` fingerprints of ``shingle`` words, ``radius`` bits of all of them."""

    shingle: int
    count: int
    radius: int


def similarity_check(shingle: int, similarity: float, count: int = 4) -> Check:
    """The check for a Jaccard ``similarity`` of the shingles. Sets of equal size with it have the cosine 2 s / (1 + s), and a
    bit differs with the probability angle / pi."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return Check(shingle, count, int(share * count * BITS))


def with_prints(docs: DataFrame, text_column: str, shingle: int, count: int, distinct: bool, check: Check | None) -> Column:
    """Array of the fingerprints, followed by those of the check."""

    def of(text: str | None) -> np.ndarray:
        own = [fingerprints(text, shingle, count, distinct)]
        if check:
            own.append(fingerprints(text, check.shingle, check.count, distinct))
        return np.concatenate(own).view(np.int64)

    @F.pandas_udf("array<long>")
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([of(t) for t in batch])

    return prints(F.col(f"`{text_column}`").cast("string"))


def turned(value: Column, segments: int) -> Column:
    """The fingerprint with the given segment first."""
    if not segments:
        return value
    return F.shiftleft(value, WIDTH * segments).bitwiseOR(F.shiftrightunsigned(value, BITS - WIDTH * segments))


def chain_lengths(radius: int) -> tuple[int, int, int]:
    """Segments whose chain must be equal, bits in each half of those that may differ in one bit, and where the halves begin."""
    exact = max(n for n in range(SEGMENTS + 1) if n * radius // SEGMENTS == 0)
    single = max(n for n in range(SEGMENTS + 1) if n * radius // SEGMENTS <= 1)
    return exact, (single - exact) * WIDTH // 2, BITS - exact * WIDTH


def half_of(ring: Column, radius: int, part: int) -> Column:
    _, half, top = chain_lengths(radius)
    return F.shiftrightunsigned(ring, top - half * (part + 1)).bitwiseAND(F.lit((1 << half) - 1).cast("long"))


def chain_keys(number: Column, value: Column, radius: int) -> Column:
    """Array of (key, ring): for each first segment two keys, and the fingerprint turned to that segment.

    A key holds the fingerprint's number, the first segment, the equal chain, one half of what follows, and in the lowest bit
    which half.
    """
    exact, half, top = chain_lengths(radius)
    keys = []
    for first in range(SEGMENTS):
        ring = turned(value, first)
        name = F.shiftleft(number.cast("long") * SEGMENTS + first, exact * WIDTH)
        head = name.bitwiseOR(F.shiftrightunsigned(ring, top)) if exact else name
        for part in range(2 if half else 1):
            tail = half_of(ring, radius, part) if half else F.lit(0).cast("long")
            key = F.shiftleft(F.shiftleft(head, half).bitwiseOR(tail), 1).bitwiseOR(F.lit(part).cast("long"))
            keys.append(F.struct(key.alias("key"), ring.alias("ring")))
    return F.array(*keys)


def chains_hold(apart: Column, radius: int) -> Column:
    """Whether every chain from the first segment on stays within its budget; the last one is the Hamming check."""
    holds = F.lit(True)
    for n in range(1, SEGMENTS + 1):
        holds &= F.bit_count(F.shiftrightunsigned(apart, BITS - n * WIDTH)) <= n * radius // SEGMENTS
    return holds


def index(nodes: DataFrame, radius: int) -> DataFrame:
    """Rows (key, node, ring) of keys that several nodes share, with the first and the last of those nodes; ``nodes``: number, print, node."""
    rows = nodes.select("node", F.explode(chain_keys(F.col("number"), F.col("print"), radius)).alias("k")).select("node", "k.key", "k.ring")
    of_key = W.partitionBy("key")
    place = F.struct("node", "ring")
    return common.cut(
        rows.select("*", F.min(place).over(of_key).alias("low"), F.max(place).over(of_key).alias("high")).where("low.node < high.node")
    )


def found_here(apart: Column, key: Column, radius: int) -> Column:
    """Whether rings with this difference are linked and this key is one that has to tell it."""
    here = (apart != 0) & chains_hold(apart, radius) & ~chains_hold(turned(apart, SEGMENTS - 1), radius)
    if chain_lengths(radius)[1]:  # with both halves equal, the first one finds the pair
        here &= (key.bitwiseAND(F.lit(1).cast("long")) == 0) | (half_of(apart, radius, 0) != 0)
    return here


def star_links(indexed: DataFrame, radius: int) -> DataFrame:
    """Links of every node to the first and the last node of its keys: at most two per row of the index."""
    near = lambda end: indexed.where(
        (F.col("node") != F.col(f"{end}.node")) & (F.bit_count(F.col("ring").bitwiseXOR(F.col(f"{end}.ring"))) <= radius)
    ).select(F.col("node").alias("a"), F.col(f"{end}.node").alias("b"))
    return near("low").union(near("high")).distinct()


def links(
    indexed: DataFrame, nodes: DataFrame, radius: int, roots: DataFrame | None = None,
    checks: DataFrame | None = None, check: Check | None = None,
) -> DataFrame:
    """Pairs a, b of nodes whose fingerprints of the same number are within ``radius``, of nodes with unequal ``roots`` (node, root) only.

    With a ``check``, pairs have to pass it too (``checks``: node, check). Nodes that some links connect already need no further
    link between them; a dense group of n near copies, which has as many links as pairs, so leaves the join with few.
    """
    def described(rows: DataFrame) -> DataFrame:
        if roots is None:
            rows = rows.withColumn("root", F.col("node"))
        else:
            rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        return rows.join(checks, "node") if check else rows

    def pairs(rows: DataFrame, on: list[str], condition) -> DataFrame:
        one, other = rows.alias("one"), rows.alias("other")
        both = F.lit(True)
        for c in on:
            both &= F.col(f"one.{c}") == F.col(f"other.{c}")
        both &= (F.col("one.node") < F.col("other.node")) & (F.col("one.root") != F.col("other.root")) & condition
        if check:
            apart = [F.bit_count(F.get("one.check", F.lit(n)).bitwiseXOR(F.get("other.check", F.lit(n)))) for n in range(check.count)]
            both &= sum(apart[1:], apart[0]) <= check.radius
        return one.join(other, both).select(F.col("one.node").alias("a"), F.col("other.node").alias("b"))

    apart = F.col("one.ring").bitwiseXOR(F.col("other.ring"))
    near = pairs(described(indexed.select("key", "node", "ring")), ["key"], found_here(apart, F.col("one.key"), radius))
    equal = pairs(described(nodes.select("number", "print", "node")), ["number", "print"], F.lit(True))
    return near.union(equal).distinct()


def checked(found: DataFrame, checks: DataFrame, radius: int) -> DataFrame:
    """The pairs whose checks (``checks``: node, check) differ in at most ``radius`` bits together."""
    side = lambda c: checks.select(F.col("node").alias(c), F.col("check").alias(f"check_{c}"))
    both = found.join(side("a"), "a").join(side("b"), "b")
    apart = F.zip_with("check_a", "check_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return both.where(F.aggregate(apart, F.lit(0), lambda n, x: n + x) <= radius).select("a", "b")


def near_groups(
    docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text",
    shingle: int = 3, radius: int = 3, count: int = 1, distinct: bool = False, check: Check | None = None,
) -> DataFrame:
    """One row per row of ``docs``: key, id, prints, component_id, stays.

    Documents are linked if one of their ``count`` fingerprints is within ``radius`` (at most 7) of the
    other's of the same number and, where a ``check`` is given, they pass it. component_id is the smallest
    id reachable, and the row with that id, of equal ids the first row, stays. Null ids come after all
    others; a component of null ids has a null one. Null, empty and blank texts have the fingerprint zero
    and are linked as any other. Texts are read whole, in blocks of bounded size. An empty table gives
    no rows.
    """
    if not 0 <= radius < SEGMENTS:
        raise ValueError(f"radius must be from 0 to {SEGMENTS - 1}")
    prints = with_prints(docs, text_column, shingle, count, distinct, check)
    printed = common.cut(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{id_column}`").alias("id"), prints.alias("prints")))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("first")
    groups = common.cut(printed.groupBy("prints").agg(first).withColumn("node", F.monotonically_increasing_id()))
    own_check = F.slice("prints", count + 1, check.count if check else 0).alias("check")
    each = groups.select("node", own_check, F.posexplode(F.slice("prints", 1, count)).alias("number", "print"))
    heads = each.groupBy("number", "print", "check").agg(F.min("node").alias("node"))
    checks = groups.select("node", own_check)
    indexed = index(heads, radius)
    known = star_links(indexed, radius)
    if check:
        known = checked(known, checks, check.radius)
    if count > 1:  # groups that share one of several fingerprints, and the check
        same = heads.withColumnRenamed("node", "head")
        known = known.union(
            each.join(same, ["number", "print", "check"]).where("node > head").select(F.col("node").alias("a"), F.col("head").alias("b"))
        )
    starred = common.cut(components(known))
    more = links(indexed, heads, radius, starred, checks, check)
    roots = common.cut(components(more.union(starred.select(F.col("node").alias("a"), F.col("root").alias("b")))))
    members = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = members.groupBy("root").agg(F.min("first").alias("of_component"))
    of_prints = members.join(of_root, "root").select("prints", "of_component")
    return printed.join(of_prints, "prints").select(
        "key", "id", "prints", F.col("of_component.id").alias("component_id"), (F.col("of_component.key") == F.col("key")).alias("stays")
    )


def without_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of ``near_groups``, the one with the smallest id."""
    keyed, key = common.row_keyed(docs)
    kept = near_groups(keyed, key, id_column, text_column, **options).where("stays").select(F.col("key").alias(key))
    return common.with_kept_rows(keyed, kept, key)


def op5(spark: SparkSession, folder: str) -> DataFrame:
    keyed, key = common.row_keyed(common.table(spark, folder, "documents"))
    return near_groups(keyed, key).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex(F.get("prints", F.lit(0))), 16, "0")).alias("fingerprint"), "component_id"
    )
