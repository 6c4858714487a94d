"""Benchmark passages in documents, found by SimHash windows of the size of the items.

An item of n words is entered with all its windows of c words, c a little below n. A document is cut into
windows of c words every n - c + 1 words, so that wherever the item stands, one window of the document
falls on exactly one window of the item. Window fingerprints are compared by multi-index hashing: a
64-bit fingerprint within RADIUS of another differs in at most RADIUS // BLOCKS bits in one of BLOCKS
blocks, so a table of all block values at that distance misses none. Longer items are entered with windows of a third
of their words too, which a block of words put into the item or taken out of it leaves whole on one side; these have to
be nearly equal, within HALF_RADIUS.

Candidates are verified on the exact words: of the five-word shingles that the item and the document around the aligned
place have in the same order, within a stretch of at most STRETCH of the item's words, the weight by rarity among all
items of the benchmark, over the whole weight of the item, has to be LEAST.

Words are those of the text in lower case without ASCII punctuation.
"""

from __future__ import annotations

import math
import string
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm import common, words

SHINGLE, LEAST = 5, 0.8
#: A match has at most this many times the words of its item.
STRETCH = 1.5
#: Features of the fingerprints are pairs of words: one changed word touches two of them.
FEATURE = 2
BITS, BLOCKS, RADIUS = 64, 4, 11
BLOCK_BITS = BITS // BLOCKS
#: Window lengths grow by this factor; a window has at most FILL of its item's words.
GROWTH, FILL, SHORTEST = 1.25, 0.85, 5
#: Items from this many words on have short windows too, of at most HALF_FILL of their words, compared within HALF_RADIUS.
HALVED, HALF_FILL, HALF_RADIUS = 40, 0.3, 3
#: Words that are held, and windowed, at a time; a longer text is held whole.
BATCH_WORDS, SPAN = 1 << 19, 1 << 14
#: Items of one pass over the documents; more items take more passes, so no task ever holds a larger index.
ITEMS_PER_PASS = 20_000

MATCH = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("start_word", T.LongType()),
    T.StructField("end_word", T.LongType()), T.StructField("similarity", T.DoubleType()),
]))


def plain(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, string.punctuation.encode())


def word_hashes(text: str | None) -> np.ndarray:
    """Hash of each word of the whole text; the words themselves are held a block at a time."""
    return np.concatenate([np.zeros(0, np.uint64), *(words.hashes(b) for b in words.word_blocks(plain(text)))])


def features(hashed: np.ndarray) -> np.ndarray:
    """Hash of each pair of neighbouring words; of a single word, its own."""
    if len(hashed) < FEATURE:
        return hashed
    return words.mixed(words.mixed(hashed[:-1], 1) + hashed[1:], 2)


def window_prints(feature: np.ndarray, length: int, starts: np.ndarray) -> np.ndarray:
    """SimHash of the windows of ``length`` words at ``starts``: a bit is set if more than half of the features set it."""
    ones = np.unpackbits(feature.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(feature) + 1, BITS), np.int64)
    np.cumsum(ones, axis=0, out=sums[1:])
    return prints_at(sums, max(1, length - FEATURE + 1), starts)


def prints_at(sums: np.ndarray, per: int, starts: np.ndarray) -> np.ndarray:
    inside = sums[starts + per] - sums[starts]
    return np.packbits(inside > per // 2, axis=1, bitorder="little").view(np.uint64).ravel()


def near_values(value: int, distance: int) -> Iterator[int]:
    for n in range(distance + 1):
        for places in combinations(range(BLOCK_BITS), n):
            yield value ^ sum(1 << p for p in places)


@dataclass
class SizeClass:
    """All item windows of one length, and for each block which of them are near each block value."""

    length: int
    step: int
    prints: np.ndarray
    items: np.ndarray
    offsets: np.ndarray
    radius: int = RADIUS
    firsts: list[np.ndarray] = field(default_factory=list)
    members: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        near = np.array(list(near_values(0, self.radius // BLOCKS)), np.int64)
        for block in range(BLOCKS):
            own = (self.prints >> np.uint64(block * BLOCK_BITS)).astype(np.int64) & ((1 << BLOCK_BITS) - 1)
            values = (own[:, None] ^ near[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            self.members.append(np.repeat(np.arange(len(own)), len(near))[order].astype(np.int32))
            self.firsts.append(np.searchsorted(values[order], np.arange((1 << BLOCK_BITS) + 1)).astype(np.int32))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``prints``, own window) within the radius, all of them, each once."""
        found = []
        for block in range(BLOCKS):
            value = (prints >> np.uint64(block * BLOCK_BITS)).astype(np.int64) & ((1 << BLOCK_BITS) - 1)
            first, count = self.firsts[block][value], self.firsts[block][value + 1] - self.firsts[block][value]
            hit = np.flatnonzero(count)
            first, count = first[hit], count[hit]
            place = np.repeat(hit, count)
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            member = self.members[block][np.repeat(first, count) + within]
            close = np.bitwise_count(prints[place] ^ self.prints[member]) <= self.radius
            found.append(place[close] * len(self.prints) + member[close])
        both = np.unique(np.concatenate(found))
        return both // len(self.prints), both % len(self.prints)


class Index:
    """Items (id, text) by size class. Fewer words than a shingle are one shingle, the whole sequence, so a short item
    matches texts of just these words; items without words, or null, match nothing.

    ``spread`` says in how many of ``total`` items each shingle occurs; without it, the items given are all there are.
    """

    def __init__(self, items: list[tuple[int, str | None]], spread: dict[int, int] | None = None, total: int | None = None):
        self.ids, self.places, self.tiny = [], [], defaultdict(list)
        hashed = []
        for item_id, text in items:
            own = word_hashes(text)
            if 0 < len(own) < SHINGLE:
                self.tiny[own.tobytes()].append(item_id)
            if len(own) < SHINGLE:
                continue
            self.ids.append(item_id)
            hashed.append(own)
            places = defaultdict(list)
            for at, s in enumerate(shingle_hashes(own).tolist()):
                places[s].append(at)
            self.places.append({s: at[::-1] for s, at in places.items()})
        if spread is None:
            spread, total = Counter(s for own in self.places for s in own), len(self.ids)
        self.weights = [{s: math.log(1 + total / spread[s]) for s in own} for own in self.places]
        self.wholes = [sum(w * len(p[s]) for s, w in own.items()) for own, p in zip(self.weights, self.places, strict=True)]
        self.lengths = [len(h) for h in hashed]
        classes = defaultdict(list)
        for n, length in enumerate(self.lengths):
            classes[window_length(length, FILL), RADIUS].append(n)
            if length >= HALVED:
                classes[window_length(length, HALF_FILL), HALF_RADIUS].append(n)
        self.classes = []
        for (length, radius), members in sorted(classes.items()):
            prints, owner, offset = [], [], []
            for n in members:
                starts = np.arange(self.lengths[n] - length + 1)
                prints.append(window_prints(features(hashed[n]), length, starts))
                owner.append(np.full(len(starts), n))
                offset.append(starts)
            step = min((self.lengths[n] if radius == RADIUS else self.lengths[n] // 2) - length + 1 for n in members)
            self.classes.append(SizeClass(length, step, np.concatenate(prints), np.concatenate(owner), np.concatenate(offset), radius))
        self.longest = max(self.lengths, default=0)

    def verified(self, n: int, shingles: list[int]) -> tuple[float, int, int]:
        """Weight of the item's shingles that stand in ``shingles`` in the item's order, at most STRETCH of its words apart,
        over their whole weight; place of the first, and the end of the last."""
        of, chain, tails = self.places[n], [], []
        for place, s in enumerate(shingles):
            for at in of.get(s, ()):  # the last place first, so that one shingle of the text is taken once
                k = bisect_left(tails, at)
                if k == len(tails):
                    tails.append(at)
                else:
                    tails[k] = at
                chain.append((k, at, place, s))
        run, k, limit = [], len(tails) - 1, math.inf
        for rank, at, place, s in reversed(chain):
            if rank == k and at < limit and (not run or place < run[-1][0]):
                run.append((place, self.weights[n][s]))
                k, limit = k - 1, at
        run.reverse()
        most, best, weight, low = int(STRETCH * self.lengths[n]) - SHINGLE, (0.0, 0, 0), 0.0, 0
        for place, w in run:
            weight += w
            while place - run[low][0] > most:
                weight -= run[low][1]
                low += 1
            best = max(best, (weight, run[low][0], place + SHINGLE), key=lambda b: b[0])
        return best[0] / self.wholes[n], best[1], best[2]

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
        """Per text (item, first word, end word, similarity) of the best place of every item with a similarity of at least LEAST,
        in the order of the items.

        Texts are put end to end, about BATCH_WORDS words at a time, and windowed together; a window never
        reaches into the next text.
        """
        out: list[list[tuple[int, int, int, float]]] = []
        held: list[np.ndarray] = []
        size = 0
        for text in texts:
            held.append(word_hashes(text))
            size += len(held[-1])
            if size >= BATCH_WORDS:
                out += self._together(held)
                held, size = [], 0
        return out + self._together(held)

    def _together(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int, float]]]:
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts]
        if self.ids and len(texts) and ends[-1] >= SHINGLE:
            hashed = np.concatenate(texts)
            shingles, seen = shingle_hashes(hashed), set()
            for n, start in self._candidates(hashed, ends - lengths, lengths):
                # one verification covers neighbouring alignments: places are told apart by quarters of the item
                size = self.lengths[n]
                owner = int(np.searchsorted(ends, max(start + size // 2, 0), side="right"))
                if owner == len(texts) or (key := (owner, n, start * 4 // size)) in seen:
                    continue
                seen.add(key)
                first = int(ends[owner] - lengths[owner])
                last = max(first, int(ends[owner]) - SHINGLE + 1)
                low, high = max(first, start - size // 2), min(last, start + size + size // 2 - SHINGLE + 1)
                alike, begin, end = self.verified(n, shingles[low:high].tolist())
                if alike >= LEAST - 1e-9 and alike > best[owner].get(n, (0.0, 0, 0))[0]:
                    best[owner][n] = (min(1.0, alike), low + begin - first, low + end - first)
        out = [[(self.ids[n], start, end, float(alike)) for n, (alike, start, end) in sorted(own.items())] for own in best]
        if self.tiny:
            for own, found in zip(texts, out, strict=True):
                found += self._tiny(own)
        return out

    def _candidates(self, hashed: np.ndarray, firsts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, place at which it would begin) for every window of the texts that is near one of an item."""
        feature = features(hashed)
        places = [window_starts(firsts, lengths, c.length, c.step) for c in self.classes]
        for low in range(0, len(hashed), SPAN):
            part = feature[low : low + SPAN + self.longest]
            ones = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums: dict = {}
            for c, starts in zip(self.classes, places, strict=True):
                starts = starts[slice(*np.searchsorted(starts, (low, low + SPAN)))]
                if not len(starts):
                    continue
                per = c.length - FEATURE + 1
                kind = np.uint8 if per < 256 else np.uint16 if per < 65536 else np.uint32
                if kind not in sums:
                    sums[kind] = np.zeros((len(part) + 1, BITS), kind)
                    np.cumsum(ones, axis=0, dtype=kind, out=sums[kind][1:])  # wraps around; differences stay right
                place, member = c.candidates(prints_at(sums[kind], per, starts - low))
                yield from zip(c.items[member].tolist(), (starts[place] - c.offsets[member]).tolist(), strict=True)

    def _tiny(self, own: np.ndarray) -> list[tuple[int, int, int, float]]:
        return [(i, 0, len(own), 1.0) for i in self.tiny.get(own.tobytes(), ())] if len(own) < SHINGLE else []


def window_starts(firsts: np.ndarray, lengths: np.ndarray, window: int, step: int) -> np.ndarray:
    """Every ``step``-th place of each text at which a window still fits, in one array."""
    count = np.where(lengths >= window, (lengths - window) // step + 1, 0)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(firsts, count) + number * step


def shingle_hashes(hashed: np.ndarray) -> np.ndarray:
    total = hashed[: len(hashed) - SHINGLE + 1].copy()
    for k in range(1, SHINGLE):
        total = words.mixed(total, k) + hashed[k : len(hashed) - SHINGLE + 1 + k]
    return total


def window_length(item_words: int, fill: float) -> int:
    """The largest of the lengths SHORTEST * GROWTH^k that is at most ``fill`` of the item, SHORTEST at least."""
    length = float(SHORTEST)
    while round(length * GROWTH) <= item_words * fill:
        length *= GROWTH
    return round(length)


def item_blocks(items: DataFrame, id_column: str, text_column: str) -> Iterator[Index]:
    """Indexes of at most ITEMS_PER_PASS items, by id; null ids come first. Repeated items are entered once.

    In how many items a shingle occurs is counted over the whole benchmark, so no similarity depends on the
    block an item falls in.
    """

    @F.arrow_udf("array<long>")
    def distinct_shingles(texts: pa.Array) -> pa.Array:
        own = [word_hashes(t) for t in texts.to_pylist()]
        return pa.array([np.unique(shingle_hashes(w)).view(np.int64).tolist() if len(w) >= SHINGLE else [] for w in own], pa.list_(pa.int64()))

    distinct = items.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")).distinct()
    own = common.cut(distinct.withColumn("shingles", distinct_shingles(F.col("text"))).withColumn("item", F.monotonically_increasing_id()))
    held = own.select("item", F.explode("shingles").alias("shingle"))
    spread = held.join(held.groupBy("shingle").agg(F.count("*").alias("n")), "shingle")
    spread = spread.groupBy("item").agg(F.collect_list(F.struct("shingle", "n")).alias("spread"))
    total = own.where(F.size("shingles") > 0).count()
    block: list[tuple[int, str | None]] = []
    counts: dict[int, int] = {}
    rows = own.join(spread, "item", "left").select("id", "text", "spread").orderBy("id", "text")
    for row in rows.toLocalIterator():
        block.append((row["id"], row["text"]))
        counts |= {s["shingle"] & 0xFFFFFFFFFFFFFFFF: s["n"] for s in row["spread"] or ()}
        if len(block) == ITEMS_PER_PASS:
            yield Index(block, counts, total)
            block, counts = [], {}
    yield Index(block, counts, total)


def matches_of(index: Index, text: Column) -> Column:
    @F.pandas_udf(MATCH)
    def apply(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(index.matches(batch.tolist()))

    return apply(text.cast("string"))


def with_matches(
    docs: DataFrame, items: DataFrame, name: str, text_column: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``docs`` with an array of its matches (item_id, start_word, end_word, similarity) in column ``name``, empty if none.

    Windows cover the whole text; a null or empty text has no match. One entry per item at
    its best place; of equal items with several ids, each. The documents are not shuffled: every block of
    items is an index of bounded size that goes to the tasks.
    """
    for number, block in enumerate(item_blocks(items, item_id, item_text)):
        found = matches_of(block, F.col(f"`{text_column}`"))
        docs = docs.withColumn(name, F.concat(F.col(name), found) if number else found)
    return docs


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", **names) -> DataFrame:
    """One row per document and item found in it: the id, item_id, start_word, end_word, similarity. Repeated rows repeat."""
    return with_matches(
        docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text")), items, "found", "text", **names
    ).select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.*")


def decontaminated(docs: DataFrame, items: DataFrame, text_column: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` in which no item is found. Null and empty texts stay; other columns pass through."""
    found = common.fresh(docs, "_found")
    return with_matches(docs, items, found, text_column, **names).where(F.size(found) == 0).drop(found)


def op8(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(common.table(spark, folder, "documents"), common.table(spark, folder, "benchmark"))
