"""Phrases whose words stand together more often than their parts do.

Only the longest windows are counted: every word begins one, made of itself and lead columns that hold the words
1, 2, … places on, padded with null from the end of the piece. The words of a batch lie in one array, so a lead column is
that array shifted, and no word crosses the network. Spark's ROLLUP over language and window columns then sums
the counts of ever shorter prefixes: the prefix of k words has the frequency of the phrase of k words, the
empty one the number of words.

A phrase of ``least`` or more occurrences holds no rarer word, pair of words or longer run, so windows are padded from
a rarer one on as well, which changes no frequency that is asked for and keeps one-off windows out of the shuffle. What is
frequent is found first, by exact counts of 64-bit hashes: words and pairs, then the longer runs of frequent pairs. Tasks are
told by a bitmap of SLOTS bits; a slot shared with a frequent run only means that a window is counted that need not be.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.llm import common

LONGEST, LEAST, TOP = 4, 30, 2_000
#: A candidate goes when a longer one that holds it has at least this many of a hundred of its occurrences.
COVERED = 80
SCALE = 2_000_000
#: Bits of the bitmap of frequent words and pairs: 8 MB, whatever the corpus.
SLOTS = 1 << 26
#: Bytes of text whose words are held at a time; longer texts are read in parts.
AT_ONCE = 1 << 21
#: Parts of one word, which many phrases share, are dealt to this many keys, and ranks are cut in as many groups first.
SALTS = 32

Frequent = Callable[[np.ndarray], np.ndarray]

IN_PIECE, BETWEEN = b" \t", b".,;:!?\n\x0b\x0c\r"
KIND = np.zeros(256, np.uint8)
KIND[list(IN_PIECE)] = 1
KIND[list(BETWEEN)] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_GAP = re.compile(b"[" + re.escape(IN_PIECE + BETWEEN) + b"]")
_WORD = b"[" + re.escape(IN_PIECE + BETWEEN) + b"]*[^" + re.escape(IN_PIECE + BETWEEN) + b"]+"


def parts(data: bytes, ahead: int) -> Iterator[tuple[bytes, int]]:
    """``data`` in parts of about AT_ONCE bytes, each with ``ahead`` more words behind it, and the length without those."""
    following = re.compile(b"(?:" + _WORD + b"){0,%d}" % ahead)
    start = 0
    while start < len(data):
        gap = _GAP.search(data, start + AT_ONCE)
        end = gap.start() if gap else len(data)
        yield data[start : following.match(data, end).end()], end - start
        start = end


def words_of(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words in lower case, where each begins, and the number of its piece."""
    letters = np.frombuffer(data, np.uint8)
    kind = KIND[letters]
    inside = kind == 0
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    bounds = np.concatenate([[0], np.cumsum(ends - begins)])
    text = pa.py_buffer(LOWER[letters[inside]].tobytes())
    words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(bounds), text)
    return words, begins, np.searchsorted(np.flatnonzero(kind == 2), begins)


def lead(column: np.ndarray, places: int, fill: int) -> np.ndarray:
    out = np.full_like(column, fill)
    out[: max(0, len(column) - places)] = column[places:]
    return out


def word_hashes(words: list[str], lang: str) -> np.ndarray:
    """64-bit hashes of words, different in each language."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first * np.uint64(0x9E3779B97F4A7C15) + second
    return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Part:
    """The words of a part of the texts of one language: ``own`` of them begin windows, the others only follow."""

    def __init__(self, data: bytes, own: int, lang: str):
        words, begins, self.piece = words_of(data)
        coded = words.dictionary_encode()
        self.distinct = coded.dictionary
        self.codes = np.asarray(coded.indices, np.int64) if len(words) else np.zeros(0, np.int64)
        self.hashes = word_hashes(self.distinct.to_pylist(), lang)
        self.own = int(np.searchsorted(begins, own))

    def together(self) -> np.ndarray:
        """Whether a word and the next one are of one piece."""
        return lead(self.piece, 1, -1) == self.piece

    def runs(self, longest: int, frequent: Frequent | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, hash and whether it is in one piece and made of frequent pairs, of the run of words that begins at each word."""
        hashes = self.hashes[self.codes]
        pairs = self.together()
        if frequent:
            pairs[pairs] = frequent(pair_hashes(hashes, lead(hashes, 1, 0))[pairs])
        run, whole = hashes, np.ones(len(hashes), bool)
        yield 1, run, whole
        for size in range(2, longest + 1):
            run = pair_hashes(run, lead(hashes, size - 1, 0))
            whole = whole & lead(pairs, size - 2, False)
            yield size, run, whole

    def sums(self, sizes: Sequence[int], frequent: Frequent | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of these lengths, with their numbers."""
        found = [np.unique(run[: self.own][whole[: self.own]], return_counts=True) for size, run, whole in self.runs(max(sizes), frequent) if size in sizes]
        return np.concatenate([h for h, _ in found]), np.concatenate([n for _, n in found])

    def windows(self, frequent: Frequent, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Codes of the distinct windows, a column for each place, and their numbers. The pad is the number of distinct words."""
        pad, columns = len(self.distinct), []
        reach = np.ones(len(self.codes), bool)
        for size, run, whole in self.runs(longest, None):
            reach = reach & whole
            reach[reach] = frequent(run[reach])
            columns.append(np.where(reach, lead(self.codes, size - 1, pad), pad)[: self.own])
        key = columns[0]
        for c in columns[1:-1]:
            _, key = np.unique(key * (pad + 1) + c, return_inverse=True)
        _, at, n = np.unique(key * (pad + 1) + columns[-1], return_index=True, return_counts=True)
        return [c[at] for c in columns], n


def by_language(batches: Iterator[pa.RecordBatch], ahead: int) -> Iterator[tuple[str, Part]]:
    """Parts of the texts of each batch, a language at a time. The end of a text ends a piece, as a line feed does."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        codes = np.asarray(langs.indices)
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            held, size = [], 0
            for row in np.flatnonzero(codes == code).tolist():
                held.append(batch.column("text")[row].as_buffer().to_pybytes())
                size += len(held[-1])
                if size > AT_ONCE:
                    yield from ((lang, Part(*p, lang)) for p in parts(b"\n".join(held), ahead))
                    held, size = [], 0
            yield from ((lang, Part(*p, lang)) for p in parts(b"\n".join(held), ahead))


def texts_of(docs: DataFrame, lang_column: str, text_column: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang_column}`").cast("string"), F.lit("und")).alias("lang"), common.text_of(text_column).alias("text"))


def lookup(packed: bytes) -> Frequent:
    bits = np.frombuffer(packed, np.uint8)

    def frequent(hashes: np.ndarray) -> np.ndarray:
        slot = hashes % np.uint64(8 * len(bits))
        return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1

    return frequent


def frequent_bits(texts: DataFrame, least: int, sizes: Sequence[int], known: bytes | None = None) -> bytes:
    """The bitmap, SLOTS / 8 bytes, of all runs of these lengths with ``least`` occurrences in a language.

    With the bitmap of the frequent pairs, only runs of such pairs are counted.
    """
    told = texts.sparkSession.sparkContext.broadcast(known)
    ahead = max(sizes) - 1

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = lookup(told.value) if told.value is not None else None
        for _, part in by_language(batches, ahead):
            hashes, n = part.sums(sizes, frequent)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n, pa.int64())], ["hash", "n"])

    totals = texts.mapInArrow(hashed, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    place = F.pmod("hash", F.lit(SLOTS)) + 1  # Spark's bitmaps count from 1
    rows = totals.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    packed = np.zeros(SLOTS // 8, np.uint8)
    for r in rows.collect():  # at most SLOTS / 32768 rows of 4 KB
        packed[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return packed.tobytes()


def windows(texts: DataFrame, bits: bytes, longest: int) -> DataFrame:
    """lang, w1 … and n: the longest windows of each part of the texts, each once."""
    told = texts.sparkSession.sparkContext.broadcast(bits)
    names = [f"w{n}" for n in range(1, longest + 1)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = lookup(told.value)
        for lang, part in by_language(batches, longest - 1):
            codes, n = part.windows(frequent, longest)
            pad = len(part.distinct)
            if pad:
                words = [part.distinct.take(pa.array(np.where(c == pad, 0, c), mask=c == pad)).cast(pa.string()) for c in codes]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *words, pa.array(n, pa.int64())], ["lang", *names, "n"])

    return texts.mapInArrow(counted, f"lang string, {', '.join(f'{n} string' for n in names)}, n long")


def frequencies(texts: DataFrame, longest: int, least: int) -> DataFrame:
    """lang, words and f of every phrase of up to ``longest`` words with ``least`` occurrences, and of no words with all."""
    names = [f"w{n}" for n in range(1, longest + 1)]
    bits = frequent_bits(texts, least, [1, 2])
    if longest > 2:
        more = frequent_bits(texts, least, range(3, longest + 1), bits)
        bits = (np.frombuffer(bits, np.uint8) | np.frombuffer(more, np.uint8)).tobytes()
    distinct = windows(texts, bits, longest).groupBy("lang", *names).agg(F.sum("n").alias("n"))
    sums = distinct.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("rolled"))
    size = longest - F.length(F.replace(F.bin("rolled"), F.lit("0"), F.lit("")))
    words = F.slice(F.array(*names), F.lit(1), F.greatest(size, F.lit(0)))
    whole = F.when(size > 0, F.array(*names)[size - 1].isNotNull() & (F.col("f") >= least)).otherwise(size == 0)
    return sums.where(whole).select("lang", words.alias("words"), "f")


def exact(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def collocations(
    docs: DataFrame, lang_column: str = "lang", text_column: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` phrases of each language.

    Texts are read whole, A-Z in lower case; pieces end at ``.,;:!?`` and line ends, words at spaces and tabs. a is the
    frequency of the phrase; of its cuts into two parts with the frequencies l and r the one with the lowest
    floor(SCALE * a / (l + r)) counts, the earliest of equals. Phrases that stand almost always in a longer one
    (COVERED) go. Ranks follow score, a and the bytes of the phrase. A null language is ``und``, a null text
    empty; repeated rows count each time; other columns are not looked at. An empty table gives no rows.
    """
    texts = texts_of(docs, lang_column, text_column)
    found = common.cut(frequencies(texts, longest, least).withColumn("phrase", F.array_join("words", " ")).withColumn("size", F.size("words")))
    totals = found.where("size = 0").select("lang", F.col("f").alias("n"))
    candidates = found.where("size > 1")

    # parts of one word may be shared by very many phrases: both sides are dealt to SALTS keys
    salt = lambda alone: F.when(alone, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    salts = F.when(F.col("size") == 1, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    known = found.where("size > 0").select("lang", F.col("phrase").alias("part"), F.explode(salts).alias("salt"), "f")
    cut = candidates.select("lang", "phrase", "size", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = F.array(
        F.struct(F.lit(True).alias("left"), F.slice("words", F.lit(1), F.col("k")).alias("words")),
        F.struct(F.lit(False).alias("left"), F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")).alias("words")),
    )
    sided = cut.withColumn("side", F.explode(sides)).select(
        "lang", "phrase", "a", "k", F.col("side.left").alias("left"), F.array_join("side.words", " ").alias("part"),
        salt(F.size("side.words") == 1).alias("salt"),
    )
    by_cut = sided.join(known, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a", "k").agg(
        F.sum(F.when(F.col("left"), F.col("f"))).alias("l"), F.sum(F.when(~F.col("left"), F.col("f"))).alias("r")
    )
    score = F.expr(f"CAST(({SCALE} * CAST(a AS decimal(20,0))) DIV (CAST(l AS decimal(20,0)) + CAST(r AS decimal(20,0))) AS long)")
    lowest = by_cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))

    spans = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1),
        lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda s: F.array_join(F.slice("words", s, n), " ")),
    ))
    inside = candidates.where("size > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "f")
    longer = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    covered = F.coalesce(100 * exact(F.col("longer")) >= COVERED * exact(F.col("a")), F.lit(False))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(~covered).select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(common.table(spark, folder, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, generate_subscripts(p, 1) AS piece, unnest(p) AS piece_text
  FROM (SELECT lang, doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents)
), split AS (
  SELECT row_number() OVER () AS piece, lang, string_split_regex(piece_text, '[\x20\x09]+') AS w FROM pieces
), words AS (
  SELECT * FROM (SELECT lang, piece, generate_subscripts(w, 1) AS at_word, unnest(w) AS w1 FROM split) WHERE w1 <> ''
), follow AS MATERIALIZED (
  SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4
  FROM words WINDOW p AS (PARTITION BY piece ORDER BY at_word)
), total AS (
  SELECT lang, count(*) AS n FROM follow GROUP BY lang
), f AS MATERIALIZED (
  SELECT lang, 1 AS size, w1 AS phrase, count(*) AS f, w1, NULL AS w2, NULL AS w3, NULL AS w4 FROM follow GROUP BY lang, w1
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*), w1, w2, NULL, NULL FROM follow WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*), w1, w2, w3, NULL FROM follow WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*), w1, w2, w3, w4 FROM follow WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4
), c AS (
  SELECT * FROM f WHERE size > 1 AND f >= 30
), cuts AS (
  SELECT lang, size, phrase, f AS a, 1 AS k, w1 AS head, concat_ws(' ', w2, w3, w4) AS tail FROM c
  UNION ALL SELECT lang, size, phrase, f, 2, concat_ws(' ', w1, w2), concat_ws(' ', w3, w4) FROM c WHERE size > 2
  UNION ALL SELECT lang, size, phrase, f, 3, concat_ws(' ', w1, w2, w3), w4 FROM c WHERE size > 3
), parts AS (
  SELECT lang || chr(9) || phrase AS part, f FROM f WHERE f >= 30
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, x.f AS l, y.f AS r,
         row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY 2000000::HUGEINT * cuts.a // (x.f + y.f), k) AS nth,
         CAST(2000000::HUGEINT * cuts.a // (x.f + y.f) AS BIGINT) AS score
  FROM cuts JOIN parts x ON x.part = cuts.lang || chr(9) || head JOIN parts y ON y.part = cuts.lang || chr(9) || tail
), inside AS (
  SELECT lang, w1 || ' ' || w2 AS phrase, f FROM c WHERE size > 2
  UNION ALL SELECT lang, w2 || ' ' || w3, f FROM c WHERE size > 2
  UNION ALL SELECT lang, w3 || ' ' || w4, f FROM c WHERE size > 3
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, f FROM c WHERE size > 3
  UNION ALL SELECT lang, w2 || ' ' || w3 || ' ' || w4, f FROM c WHERE size > 3
), longer AS (
  SELECT lang, phrase, max(f) AS f FROM inside GROUP BY lang, phrase
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN longer g USING (lang, phrase) WHERE nth = 1 AND NOT coalesce(100::HUGEINT * g.f >= 80::HUGEINT * a, false)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
) JOIN total USING (lang) WHERE rank <= 2000
"""
