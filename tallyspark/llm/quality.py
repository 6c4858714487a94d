"""Text quality by ordinal (cumulative-link) regression on graded ratings.

One set of weights over hashed text features gives a score s, and ordered thresholds cut it into grades:
P(grade <= k) = sigmoid(t_k - s). So a text gets an expected grade and, for selection, the probability of
reaching a grade. Features are the words a text has, the share of its words of each shape (letters,
capitals, digits and marks, runs drawn together) and the share of repeated words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm import common, words

#: Hashed dimensions, halves for words and for shapes and shares.
DIMENSIONS = 1 << 18
#: Bound of the training sample: rated rows.
MOST_RATED = 8_000
#: A feature that fewer rated texts have is not learned.
LEAST_TEXTS = 8
EPOCHS, BATCH, RATE, SHRINK = 12, 128, 0.1, 1e-5
#: A text is selected if it reaches the best grade with at least this probability; short texts, which say little, stay above it.
LEAST_TAIL = 0.3

_CLASSES = bytes(
    ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else ord("a") if 97 <= b <= 122 or b >= 128 else b for b in range(256)
)


def shapes(data: bytes) -> Counter:
    """How many words have each shape: character classes, runs of one class drawn together."""
    kinds = np.frombuffer(data.translate(_CLASSES), np.uint8)
    if not len(kinds):
        return Counter()
    return Counter(kinds[np.r_[True, kinds[1:] != kinds[:-1]]].tobytes().split())


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the whole text; none for a text without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    half = np.uint64(DIMENSIONS // 2 - 1)
    distinct, total, form = np.zeros(0, np.uint64), 0, Counter()
    for block in words.word_blocks(data):
        lower = [w.lower() for w in block]
        distinct = np.union1d(distinct, words.hashes(lower))
        total += len(block)
        form.update(shapes(b" ".join(block)))
    if not total:
        return np.zeros(0, np.int64), np.zeros(0)
    names = [*form, b"repeated"]
    at = np.concatenate([np.unique(distinct & half).astype(np.int64), (words.hashes(names) & half).astype(np.int64) + DIMENSIONS // 2])
    values = np.ones(len(at))
    values[-len(names) :] = [*(n / total for n in form.values()), 1 - len(distinct) / total]
    return at, values


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: float) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -500, 500)))

    def score(self, text: str | None) -> float:
        at, values = features(text)
        return float(self.weights[at] @ values)


def train(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, seed: int = 5) -> Ordinal:
    """Adagrad on the likelihood, every rated text alike, so that probabilities keep the shares of the grades. Thresholds are a first one and positive gaps, so they stay in order."""
    random = np.random.default_rng(seed)
    seen = np.bincount(np.concatenate([at for at, _ in rows]), minlength=DIMENSIONS)
    rows = [(at[seen[at] >= LEAST_TEXTS], v[seen[at] >= LEAST_TEXTS]) for at, v in rows]
    w, first, gaps = np.zeros(DIMENSIONS), np.array([-0.5]), np.zeros(max(0, levels - 2))
    squares = [np.full_like(x, 1e-6) for x in (w, first, gaps)]
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            some = order[start : start + BATCH]
            at = np.concatenate([rows[i][0] for i in some])
            values = np.concatenate([rows[i][1] for i in some])
            of = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
            s = np.bincount(of, w[at] * values, len(some))
            cuts = np.concatenate([[-np.inf], first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]), [np.inf]])
            y = grades[some]
            upper, lower = logistic(cuts[y + 1] - s), logistic(cuts[y] - s)
            chance = np.maximum(upper - lower, 1e-9)
            d_upper, d_lower = upper * (1 - upper) / chance, lower * (1 - lower) / chance
            scale = 1 / len(some)
            of_cut = np.zeros(levels + 1)
            np.add.at(of_cut, y + 1, -scale * d_upper)
            np.add.at(of_cut, y, scale * d_lower)
            inner = of_cut[1:levels]
            of_score = scale * (d_upper - d_lower)
            changed, place = np.unique(at, return_inverse=True)
            of_w = np.bincount(place, of_score[of] * values) + SHRINK * w[changed]
            slopes = (of_w, np.array([inner.sum()]), np.cumsum(inner[:0:-1])[::-1] * np.exp(gaps))
            for x, g, q, where in zip((w, first, gaps), slopes, squares, (changed, slice(None), slice(None)), strict=True):
                q[where] += g * g
                x[where] -= RATE * g / np.sqrt(q[where])
    return Ordinal(w, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def learn(rated: DataFrame, levels: int, text_column: str = "text", grade_column: str = "grade") -> Ordinal | None:
    """The regression of at most MOST_RATED rated rows, drawn by a hash of text and grade, copies once; None without any.

    Rows with a null text, no word, or a grade that is null or not in 0 ... levels - 1 teach nothing.
    """

    @F.pandas_udf("struct<at binary, of binary>")
    def packed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([tuple(x.tobytes() for x in features(t)) for t in batch], columns=["at", "of"])

    text, grade = F.col(f"`{text_column}`").cast("string"), F.col(f"`{grade_column}`").cast("int")
    usable = rated.where(text.isNotNull() & grade.between(0, levels - 1)).select(text.alias("text"), grade.alias("grade"))
    count = usable.count()
    rate = min(1 << 30, (3 * MOST_RATED << 29) // max(1, count))
    drawn = usable.withColumn("draw", F.xxhash64("text", "grade")).where(F.pmod("draw", F.lit(1 << 30)) < rate).dropDuplicates(["draw"])
    some = drawn.select("draw", "grade", packed("text").alias("f")).orderBy("draw", "grade").limit(MOST_RATED).collect()
    rows = [(np.frombuffer(r["f"]["at"], np.int64), np.frombuffer(r["f"]["of"], np.float64)) for r in some]
    full = [n for n, (at, _) in enumerate(rows) if len(at)]
    if not full:
        return None
    return train([rows[n] for n in full], np.array([some[n]["grade"] for n in full]), levels)


def graded(model: Ordinal | None, text: Column, levels: int) -> Column:
    """Struct (expected_grade, tail): the expected grade and the probabilities of reaching grades 1, 2, ...; null for a text without words."""
    result = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.ArrayType(T.DoubleType()))])

    def judge(t: str | None) -> tuple:
        if model is None or not t or not t.strip(common.WHITE):
            return None, None
        tails = model.tails(model.score(t))
        return float(tails.sum()), tails.tolist()

    @F.pandas_udf(result)
    def apply(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([judge(t) for t in batch], columns=["expected_grade", "tail"])

    return apply(text.cast("string"))


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 toxic, 1 not toxic but of low quality, 2 neither; null where the labels do not say."""
    grade = F.when(F.col("toxic") == 1, 0).when((F.col("toxic") == 0) & (F.col("quality") == 0), 1).when(
        (F.col("toxic") == 0) & (F.col("quality") == 1), 2
    )
    return labels.select("doc_id", grade.alias("grade"))


LEVELS = 3


def rated_sample(docs: DataFrame, rated: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """text, grade of at most MOST_RATED rated ids, drawn by a hash of the id. Only this bounded list is broadcast; no text is shuffled."""
    drawn = rated.where("grade IS NOT NULL").orderBy(F.xxhash64(id_column, "grade"), id_column, "grade").limit(MOST_RATED)
    text = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`").alias("text"))
    return common.cut(text.join(F.broadcast(drawn.select(id_column, "grade")), id_column).select("text", "grade"))


def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents").select("doc_id", "text")
    model = learn(rated_sample(docs, ratings(common.table(spark, folder, "labels"))), LEVELS)
    return docs.select("doc_id", graded(model, F.col("text"), LEVELS).alias("g")).select(
        "doc_id", F.col("g.expected_grade").alias("expected_grade"),
        F.get("g.tail", F.lit(0)).alias("p_not_toxic"), F.get("g.tail", F.lit(1)).alias("p_good"),
        F.coalesce(F.get("g.tail", F.lit(1)) >= LEAST_TAIL, F.lit(False)).alias("keep"),
    )
