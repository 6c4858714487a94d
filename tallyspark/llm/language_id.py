"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over a window of WINDOW bytes, the largest answer of each
filter goes to a softmax over the languages. The network is trained in numpy on windows of labelled texts, a
bounded sample; some are shortened at random, so that short texts are known too. A text is cut into
windows, all of them, and their probabilities are averaged by the number of letters each window holds.
Case carries no language: texts are read in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm import common

WINDOW = 256
EMBEDDING, WIDTHS, FILTERS = 8, (2, 3, 4), 16
#: Bounds of the training sample: windows of a language, windows of all, characters a window is cut from. Every language is learned.
WINDOWS_PER_LANGUAGE, WINDOWS, CUT = 1_500, 96_000, 300
EPOCHS, BATCH, RATE = 10, 64, 0.004
#: Training windows are cut to a random length from here on; beyond WINDOW means not at all.
SHORTEST = 8
#: Windows of a text that go through the network at once.
AT_ONCE = 64
UNKNOWN = "und"
#: Below this score a language is rejected. Chance gives 1 / languages; short clean texts score low, so it is no higher.
LEAST_SCORE = 0.3

RESULT = T.StructType([T.StructField("language", T.StringType()), T.StructField("score", T.DoubleType())])

#: How many letters a byte begins: 1 for ASCII letters and for first bytes of longer characters.
LETTERS = np.zeros(256, np.float32)
LETTERS[[*range(65, 91), *range(97, 123)]] = 1
LETTERS[194:245] = 1


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.out, self.out_bias]


def bytes_of(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def windows_of(data: bytes) -> np.ndarray:
    """The whole of ``data`` in rows of WINDOW bytes, the last one filled up with zeros."""
    count = max(1, -(-len(data) // WINDOW))
    padded = np.zeros(count * WINDOW, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return padded.reshape(count, WINDOW)


def forward(net: Network, rows: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
    """Probabilities, for training also what each width saw and where each filter was largest, and the pooled answers."""
    embedded = net.embedding[rows]
    pooled, seen = [], []
    for width, weights, bias in zip(WIDTHS, net.filters, net.biases, strict=True):
        places = rows.shape[1] - width + 1
        spread = np.concatenate([embedded[:, k : k + places] for k in range(width)], axis=2)
        answers = spread.reshape(-1, width * EMBEDDING) @ weights
        answers = answers.reshape(len(rows), places, FILTERS)
        at = answers.argmax(axis=1)
        best = np.take_along_axis(answers, at[:, None], axis=1)[:, 0] + bias
        seen.append((spread, at, best > 0))
        pooled.append(np.maximum(best, 0))
    joined = np.concatenate(pooled, axis=1)
    scores = joined @ net.out + net.out_bias
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True), seen, joined


def probabilities(net: Network, rows: np.ndarray) -> np.ndarray:
    """``forward`` for application: only the largest answers, without their places."""
    embedded = net.embedding[rows].reshape(len(rows), -1)
    pooled = np.empty((len(rows), len(WIDTHS) * FILTERS), np.float32)
    for n, (width, weights, bias) in enumerate(zip(WIDTHS, net.filters, net.biases, strict=True)):
        places = rows.shape[1] - width + 1
        spread = np.lib.stride_tricks.sliding_window_view(embedded, width * EMBEDDING, axis=1)[:, :: EMBEDDING]
        answers = np.ascontiguousarray(spread).reshape(-1, width * EMBEDDING) @ weights
        pooled[:, n * FILTERS : (n + 1) * FILTERS] = np.maximum(answers.reshape(len(rows), places, FILTERS).max(axis=1) + bias, 0)
    scores = pooled @ net.out + net.out_bias
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Adam on the cross entropy, classes weighted to equal shares. The same rows give the same network."""
    random = np.random.default_rng(seed)
    normal = lambda *shape: random.normal(0, (2 / shape[0]) ** 0.5, shape).astype(np.float32)
    net = Network(
        languages, random.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), [normal(w * EMBEDDING, FILTERS) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(len(WIDTHS) * FILTERS, len(languages)), np.zeros(len(languages), np.float32),
    )
    share = np.bincount(labels, minlength=len(languages)).astype(np.float32)
    weight = len(labels) / (len(languages) * np.maximum(share, 1))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            some = order[start : start + BATCH]
            seen_rows = rows[some].copy()
            length = random.integers(SHORTEST, 2 * WINDOW, len(some))
            seen_rows[np.arange(WINDOW) >= length[:, None]] = 0
            chance, seen, joined = forward(net, seen_rows)
            slope = chance.copy()
            slope[np.arange(len(some)), labels[some]] -= 1
            slope *= (weight[labels[some]] / len(some))[:, None]
            back = slope @ net.out.T
            of_embedding, of_filters, of_biases = np.zeros_like(net.embedding), [], []
            for n, (width, (spread, at, alive)) in enumerate(zip(WIDTHS, seen, strict=True)):
                d = back[:, n * FILTERS : (n + 1) * FILTERS] * alive
                where = np.arange(len(some))[:, None]
                inputs = spread[where, at]
                of_filters.append(np.einsum("bfi,bf->if", inputs, d))
                of_biases.append(d.sum(axis=0))
                into = d[:, :, None] * net.filters[n].T[None]
                for k in range(width):
                    np.add.at(of_embedding, seen_rows[where, at + k], into[:, :, k * EMBEDDING : (k + 1) * EMBEDDING])
            slopes = [of_embedding, *of_filters, *of_biases, joined.T @ slope, slope.sum(axis=0)]
            step += 1
            for p, g, (m, v) in zip(net.parameters(), slopes, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def identify(net: Network | None, text: str | None) -> tuple[str, float]:
    """Language and probability of the whole text; ``und`` with 0.0 if it is null or has no letter, or if nothing was learned."""
    if net is None or not text or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    rows = windows_of(bytes_of(text))
    total = np.zeros(len(net.languages))
    for start in range(0, len(rows), AT_ONCE):
        some = rows[start : start + AT_ONCE]
        total += (LETTERS[some].sum(axis=1) + 1e-3) @ probabilities(net, some)
    best = int(total.argmax())
    return net.languages[best], float(min(1.0, total[best] / total.sum()))


def sample(docs: DataFrame, text_column: str, label_column: str) -> tuple[list[str], list[tuple[str, str]]]:
    """The languages to learn, by frequency and name, and (language, cut of a text) of each, at most WINDOWS_PER_LANGUAGE.

    With many languages each has fewer, WINDOWS in all but at least one; languages are few enough to be listed on the driver.
    Rows are drawn by a hash of the text alone, and the place of the cut comes from another, so the sample
    does not change with partitioning. Each language has its own rate, found from its number of rows.
    """
    language, text = F.col(f"`{label_column}`").cast("string"), common.text_of(text_column)
    usable = docs.where(language.isNotNull() & text.rlike(r"\p{L}")).select(language.alias("language"), text.alias("text"))
    counts = usable.groupBy("language").count().orderBy(F.desc("count"), "language").collect()
    most = max(1, min(WINDOWS_PER_LANGUAGE, WINDOWS // max(1, len(counts))))
    draw = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 30))
    rates = docs.sparkSession.createDataFrame(
        [(r["language"], min(1 << 30, (3 * most << 29) // r["count"])) for r in counts], "language string, rate long"
    )
    room = F.greatest(F.length("text") - CUT + 1, F.lit(1))
    drawn = usable.withColumn("draw", draw).join(F.broadcast(rates), "language").where(F.col("draw") < F.col("rate")).select(
        "language", "draw", F.substring("text", F.pmod(F.xxhash64("text", F.lit(2)), room).cast("int") + 1, F.lit(CUT)).alias("cut")
    ).distinct()  # copies of a text teach once
    first = W.partitionBy("language").orderBy("draw", "cut")
    rows = drawn.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most)
    return [r["language"] for r in counts], [(r["language"], r["cut"]) for r in rows.orderBy("language", "n").collect()]


def learn(docs: DataFrame, text_column: str = "text", label_column: str = "lang") -> Network | None:
    """The network for the labelled rows of ``docs``; None if there are none. Rows with a null label or no letter teach nothing."""
    languages, cuts = sample(docs, text_column, label_column)
    if not cuts:
        return None
    rows = np.concatenate([windows_of(bytes_of(cut)[:WINDOW]) for _, cut in cuts])
    place = {name: n for n, name in enumerate(languages)}
    return train(rows, np.array([place[name] for name, _ in cuts]), languages)


def predicted(net: Network | None, text: Column) -> Column:
    """Struct (language, score) for a text column. Windows pass through the network AT_ONCE at a time, whatever the length."""

    @F.pandas_udf(RESULT)
    def apply(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([identify(net, t) for t in batch], columns=["language", "score"])

    return apply(text.cast("string"))


def accepted(docs: DataFrame, training: DataFrame, text_column: str = "text", label_column: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` with a language: those without a letter and those scored below ``least`` go.

    The network is learned from ``training``. Without labelled rows nothing is learned and every row goes
    as unknown. Null and empty texts go. Repeated rows are judged alike. Other columns pass through.
    """
    judged = common.fresh(docs, "_judged")
    result = docs.withColumn(judged, predicted(learn(training, text_column, label_column), F.col(f"`{text_column}`")))
    return result.where((F.col(f"{judged}.language") != UNKNOWN) & (F.col(f"{judged}.score") >= least)).drop(judged)


def fold(id_column: str, parts: int) -> Column:
    return F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")) % parts


def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Learned on the documents of the other four folds; a null doc_id has no fold and is neither learned from nor held out."""
    docs = common.table(spark, folder, "documents")
    net = learn(docs.where(fold("doc_id", 5) != 0))
    return docs.select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), predicted(net, F.col("text")).alias("r")
    ).select("doc_id", "held_out", F.col("r.language").alias("lang_pred"), F.col("r.score").alias("score"))
