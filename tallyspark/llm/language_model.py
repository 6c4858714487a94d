"""Scoring texts by a bigram model with deleted interpolation.

    P(w | v) = a2(b) c(v w) / c(v) + a1(b) c(w) / N + a0(b) / (V + 1),   b = bucket of c(v) by powers of two

The counts are those of all training texts. The weights of each bucket come from expectation-maximisation on
a held-out part of the training texts, scored with the counts of the rest ("deleted" from the whole).

Counting never moves a row per word. Documents form chunks by their place in the input. A task lists the
distinct words and word pairs of a chunk with their counts, sorted by hash and cut into hash ranges; each range
adds up what all chunks sent and answers every chunk with the totals, in the chunk's own order. So a word
pair in a third of all places crosses the network once per chunk. The answers meet the chunk's texts again
for scoring. Words and pairs are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm import common, words

#: Documents of a chunk if none is longer than this, and bytes of text for each hash range of the counts.
CHUNK_ROWS, SHORT_TEXT, RANGE_BYTES = 2_048, 8 << 10, 8 << 20
#: Role of a text: only scored; counted; counted, and held out while the weights are learned.
SCORED, COUNTED, HELD_OUT = 0, 1, 2
HELD_OUT_PARTS, ROUNDS = 8, 40
#: Probabilities are binned for learning the weights: bins per octave, and the last bin.
PER_OCTAVE, LAST_BIN = 4, 191
NO_BIN, BUCKETS = -1, 64

END = np.array([0x9AE16A3B2F90404E], np.uint64)
WORD, PAIR = np.uint64(0xFFFFFFFFFFFFFFFE), np.uint64(1)


@dataclass
class Counted:
    """The tokens of some texts and their distinct words and pairs; totals refer to the sorted keys."""

    sizes: np.ndarray
    word_of: np.ndarray
    pair_of: np.ndarray
    n_words: int
    keys: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Counted:
        """Each text is its words and one end. The start of a text is the end before it: both are counted as often."""
        parts, sizes = [], []
        for text in texts:
            before = len(parts)
            parts += [words.hashes(block) for block in words.word_blocks(words.lowered(text))]
            parts.append(END)
            sizes.append(sum(map(len, parts[before:])))
        tokens = np.concatenate(parts)
        pairs = words.mixed(words.mixed(np.roll(tokens, 1), 1) + tokens, 2) | PAIR
        own_words, word_of = np.unique(tokens & WORD, return_inverse=True)
        own_pairs, pair_of = np.unique(pairs, return_inverse=True)
        keys = np.concatenate([own_words, own_pairs])
        order = np.argsort(keys)
        return cls(np.array(sizes), word_of, pair_of, len(own_words), keys[order], order)

    def counts(self, counted: np.ndarray) -> np.ndarray:
        """How often each key occurs in the texts that are ``counted``."""
        of_token = np.repeat(counted, self.sizes)
        both = [
            np.bincount(of[of_token], minlength=n)
            for of, n in ((self.word_of, self.n_words), (self.pair_of, len(self.keys) - self.n_words))
        ]
        return np.concatenate(both)[self.order]

    def of_tokens(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token the totals of its word, of the word before, and of the pair."""
        placed = np.empty(len(self.keys), np.int64)
        placed[self.order] = totals
        word = placed[: self.n_words][self.word_of]
        return word, np.roll(word, 1), placed[self.n_words :][self.pair_of]


def packed(values: np.ndarray) -> bytes:
    """Whole numbers of the least width that holds them, byte by byte, compressed: the high bytes are mostly equal."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << 8 * w)
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{data[0]}").ravel().astype(kind)


#: The texts that are held out have requests of their own, so that learning the weights reads them alone.
PLACE = "file long, chunk long, apart boolean, low long, high long, bucket long, "
REQUEST = PLACE + "steps binary, counted binary"
ANSWER = PLACE + "totals binary, held_out binary, tokens long, held_out_tokens long, distinct_words long"


def requests(buckets: int):
    """Of each chunk, or part of it that a task sees: its keys, as steps from one to the next, and counts, cut into hash ranges."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (file, chunk, apart), rows in batch.groupby(["file", "chunk", "apart"], sort=False):
                rows = rows.sort_values("at")
                own = Counted.of(rows["text"].tolist())
                counted = own.counts(rows["counts"].to_numpy(bool))
                bucket = bucket_of(own.keys, buckets)
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                ends = np.r_[starts[1:], len(bucket)]
                low, high = int(rows["at"].iloc[0]), int(rows["at"].iloc[-1])
                yield pd.DataFrame(
                    [
                        (file, chunk, apart, low, high, int(bucket[a]), packed(np.diff(own.keys[a:b], prepend=np.uint64(0))), packed(counted[a:b]))
                        for a, b in zip(starts, ends, strict=True)
                    ],
                    columns=["file", "chunk", "apart", "low", "high", "bucket", "steps", "counted"],
                )

    return apply


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def answers(rows: pd.DataFrame) -> pd.DataFrame:
    """Adds up one hash range and answers each request in its order; the first answer carries the range's sums."""
    keys = [np.cumsum(unpacked(k, np.uint64)) for k in rows["steps"]]
    sizes = np.array([len(k) for k in keys])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    counted = np.concatenate([unpacked(c) for c in rows["counted"]])
    apart = rows["apart"].to_numpy(bool)
    add = lambda n: np.bincount(at, n, len(distinct)).astype(np.int64)  # noqa: E731  (exact below 2^53)
    total, held_out = add(counted), add(counted * np.repeat(apart, sizes))
    of = list(zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), apart, strict=True))
    first, is_word = np.arange(len(rows)) == 0, (distinct & PAIR) == 0
    return rows[["file", "chunk", "apart", "low", "high", "bucket"]].assign(
        totals=[packed(total[at[a:b]]) for a, b, _ in of],
        held_out=[packed(held_out[at[a:b]]) if x else None for a, b, x in of],
        tokens=first * int(total[is_word].sum()), held_out_tokens=first * int(held_out[is_word].sum()),
        distinct_words=first * int((total[is_word] > 0).sum()),
    )


def parts(docs: pd.DataFrame, answered: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, Counted, pd.DataFrame]]:
    """The parts of a chunk as they were asked for, with their answers in order."""
    docs = docs.sort_values("at")
    for (low, high), own in answered.groupby(["low", "high"]):
        rows = docs[(docs["at"] >= low) & (docs["at"] <= high)]
        yield rows, Counted.of(rows["text"].tolist()), own.sort_values("bucket")


def whole(answers_of_part: pd.Series) -> np.ndarray:
    return np.concatenate([unpacked(d) for d in answers_of_part])


def bucket_of_count(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 0)


def share(part: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    return part / np.maximum(whole, 1)


def bins(p: np.ndarray) -> np.ndarray:
    size = np.floor(-np.log2(np.where(p > 0, p, 1.0)) * PER_OCTAVE).astype(np.int64)
    return np.where(p > 0, np.minimum(size, LAST_BIN), NO_BIN)


def held_out_bins(n_rest: int):
    """Counts of held-out tokens by context bucket and binned pair and word probabilities, from the counts of the rest."""

    def apply(docs: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros(0, np.int64)]
        for _, own, told in parts(docs, answered):
            word, before, pair = own.of_tokens(whole(told["totals"]) - whole(told["held_out"]))
            found.append(bucket_of_count(before) << 20 | (bins(share(pair, before)) + 1) << 10 | (bins(share(word, n_rest)) + 1))
        code, n = np.unique(np.concatenate(found), return_counts=True)
        return pd.DataFrame({"code": code, "n": n})

    return apply


def learned_weights(code: np.ndarray, n: np.ndarray, distinct: int) -> np.ndarray:
    """BUCKETS x (pair, word, uniform) by expectation-maximisation; a bucket without held-out tokens gets the weights of all."""
    middle = lambda b: np.where(b > 0, 2.0 ** (-(b - 1 + 0.5) / PER_OCTAVE), 0.0)
    bucket = code >> 20
    p = np.stack([middle(code >> 10 & 1023), middle(code & 1023), np.full(len(code), 1 / (distinct + 1))], axis=1)

    def fitted(own: np.ndarray) -> np.ndarray:
        weights = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            mixed = p[own] * weights
            weights = (n[own, None] * mixed / mixed.sum(axis=1, keepdims=True)).sum(axis=0)
            weights /= weights.sum()
        return weights

    if not len(code):
        return np.tile([0.0, 0.0, 1.0] if not distinct else [0.3, 0.6, 0.1], (BUCKETS, 1))
    everywhere = fitted(np.ones(len(code), bool))
    return np.stack([fitted(bucket == b) if (bucket == b).any() else everywhere for b in range(BUCKETS)])


@dataclass
class Model:
    weights: np.ndarray
    tokens: int
    distinct: int

    def scores(self, own: Counted, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens that were counted anywhere, base score, log10 of the model's probability."""
        word, before, pair = own.of_tokens(totals)
        of_text = lambda x: np.add.reduceat(x, np.cumsum(own.sizes) - own.sizes)
        w = self.weights[bucket_of_count(before)]
        chance = w[:, 0] * share(pair, before) + w[:, 1] * share(word, self.tokens) + w[:, 2] / (self.distinct + 1)
        # a context that was never counted says nothing about pairs: its weight goes to the word and uniform parts
        chance = np.where(before > 0, chance, chance / np.maximum(w[:, 1] + w[:, 2], 1e-300))
        base = np.log10((word + 1) / (self.tokens + self.distinct + 1))
        return of_text((word > 0).astype(np.int64)), of_text(base), of_text(np.log10(np.maximum(chance, 1e-300)))


def chunk_of(at: Column, size: Column) -> Column:
    """The chunk of a text of ``size`` bytes at a place of its file. Texts of one doubling of SHORT_TEXT share chunks, of half as
    many places for each doubling, so a chunk has at most CHUNK_ROWS * SHORT_TEXT bytes (16 MB), or a single longer text."""
    doublings = F.when(size < SHORT_TEXT, 0).otherwise(F.length(F.bin(F.floor(size / SHORT_TEXT))))
    places = F.greatest(F.floor(F.lit(CHUNK_ROWS) / F.pow(F.lit(2), doublings)), F.lit(1))
    return doublings.cast("long") * (1 << 48) + F.floor(at / places)


def scored(docs: DataFrame, role: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, role, n_tokens, n_known, train_tokens, base_score, score.

    Column ``role`` says of each row whether it is only scored (null, 0 or less), counted (1), or counted and held
    out while the weights are learned (2). A null text is an empty one: it has one token, the end. Texts
    are read whole. With nothing counted every token has probability 1. Repeated rows count and are
    scored each. An empty table gives no rows. Other columns are not looked at.
    """
    keyed, key = common.row_keyed(docs)
    given = F.coalesce(F.col(f"`{role}`").cast("int"), F.lit(SCORED))
    rows = keyed.select(
        F.col(f"`{key}`.file").alias("file"), chunk_of(F.col(f"`{key}`.at"), F.octet_length(common.text_of(text_column))).alias("chunk"), (given == HELD_OUT).alias("apart"),
        F.col(f"`{key}`.at").alias("at"), F.col(f"`{id_column}`").alias("id"), given.alias("role"), (given >= COUNTED).alias("counts"),
        common.text_of(text_column).alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    asked = rows.drop("id", "role").mapInPandas(requests(max(1, -(-size // RANGE_BYTES))), REQUEST)
    answered = common.stored(asked.groupBy("bucket").applyInPandas(answers, ANSWER), "counts")
    sums = answered.agg(F.sum("tokens"), F.sum("held_out_tokens"), F.sum("distinct_words")).first()
    tokens, held_out, distinct = (int(x or 0) for x in sums)

    def with_answers(some: DataFrame, told: DataFrame, function, schema) -> DataFrame:
        of = ["file", "chunk", "apart"]
        return some.groupBy(*of).cogroup(told.groupBy(*of)).applyInPandas(function, schema)

    histogram = with_answers(rows.where("apart"), answered.where("apart"), held_out_bins(tokens - held_out), "code long, n long")
    learned = histogram.groupBy("code").agg(F.sum("n").alias("n")).toPandas()  # bounded by buckets times bins
    model = Model(learned_weights(learned["code"].to_numpy(np.int64), learned["n"].to_numpy(np.float64), distinct), tokens, distinct)

    def score(some: pd.DataFrame, answers_of: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, own, told in parts(some, answers_of):
            known, base, chance = model.scores(own, whole(told["totals"]))
            out.append(part[["id", "role"]].assign(
                n_tokens=own.sizes, n_known=known, train_tokens=model.tokens, base_score=base, score=chance
            ))
        return pd.concat(out)

    result = T.StructType([
        T.StructField("id", docs.schema[id_column].dataType), T.StructField("role", T.IntegerType()),
        *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])
    return with_answers(rows.drop("counts"), answered.drop("held_out"), score, result)


def op9(spark: SparkSession, folder: str) -> DataFrame:
    """A null doc_id has no fold: it is neither learned from nor held out."""
    docs = common.table(spark, folder, "documents").select("doc_id", "text")
    name = F.col("doc_id").cast("string")
    fold = F.crc32(name.cast("binary")) % 7
    held_out = F.crc32(F.concat(F.lit("weights|"), name).cast("binary")) % HELD_OUT_PARTS == 0
    role = F.when(fold == 2, F.lit(-1)).when(fold.isNull(), F.lit(SCORED)).when(held_out, F.lit(HELD_OUT)).otherwise(F.lit(COUNTED))
    return scored(docs.withColumn("role", role), "role").select(
        F.col("id").alias("doc_id"), (F.col("role") == -1).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )
