"""Personal data and secrets in texts.

Base spans (email, ip, card, phone) are exact patterns with checks. Secrets have no pattern of their own, so
they are learned without labels: every run of key-like characters that holds a digit is a candidate, labelers
of three kinds (regular expressions, gazetteers, context) vote on it or abstain, expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is, and a logistic classifier of
the span's own features, trained on the resulting probabilities, decides. It adds spans of the kind
``secret`` and never takes a base span away.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm import common, words

#: Kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "secret")
SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
]))
FOUND = T.StructType([T.StructField("base", SPANS), T.StructField("added", SPANS)])

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards: a local part cannot hold one, so the leftmost start is where its run of characters begins."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four parts at a time of each chain of dotted numbers."""
    for chain in _DOTTED.finditer(text):
        parts = chain.group().split(".")
        start = chain.start()
        while len(parts) >= 4:
            four, parts = parts[:4], parts[4:]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and kind. Per kind leftmost and without overlap; failing matches are dropped."""
    found = [("email", *span) for span in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *span) for span in addresses(text)]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


#: Candidates are at least this long; votes look at so many characters before them.
SHORTEST, BEFORE = 12, 32
_KEYLIKE = re.compile(r"[A-Za-z0-9_+/-]++")
_RUN = re.compile(r"[0-9]++")
_TAIL = re.compile(r"[A-Za-z0-9_+/-]*\Z")

#: Prefixes of well-known key formats, words that announce a secret, and words that announce something else.
_PREFIX = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{12,}\Z|gh[pousr]_|sk-|xox[abprs]-|eyJ|AIza|glpat-")
_HEX = re.compile(r"(?:[0-9a-f]{16,}|[0-9A-F]{16,})\Z")
_ANNOUNCES = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[ _-]?key|access[ _-]?key|auth|bearer|credential)s?\W{0,5}\Z")
_OTHERWISE = re.compile(r"(?i)(?:https?:|www\.|/|isbn|version|doi|page|=[0-9-]*)\W{0,3}\Z")
_ASSIGNED = re.compile(r"[=:]\s?[\"']?\Z")


def candidates(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of key-like characters that hold a digit and a letter and meet no span of ``taken``."""
    end, n = 0, 0
    for run in _RUN.finditer(text):
        if run.start() < end:
            continue
        start = run.start()
        while start > end and (text[start - 1] in _LOCAL or text[start - 1] == "/") and text[start - 1] not in ".%":
            start -= 1
        end = _KEYLIKE.match(text, start).end()
        if end - start < SHORTEST or not any(map(str.isalpha, text[start:end])):
            continue
        while n < len(taken) and taken[n][2] <= start:
            n += 1
        if n == len(taken) or taken[n][1] >= end:
            yield start, end


def entropy(span: str) -> float:
    return -sum(n / len(span) * math.log2(n / len(span)) for n in Counter(span).values())


def changes(span: str) -> int:
    kinds = [c.isdigit() for c in span]
    return sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))


def votes(text: str, start: int, end: int) -> tuple[int, ...]:
    """One vote of each labeler: 1 for a secret, -1 against, 0 abstains."""
    span, before = text[start:end], text[max(0, start - BEFORE) : start]
    digits = sum(map(str.isdigit, span)) / len(span)
    mixed, spread = changes(span), entropy(span)
    return (
        1 if _PREFIX.match(span) else 0,  # regex
        1 if _HEX.match(span) else 0,
        1 if _ANNOUNCES.search(before) else 0,  # gazetteer
        -1 if _OTHERWISE.search(before) and not _ANNOUNCES.search(before) else 0,
        1 if _ASSIGNED.search(before) else -1,  # context
        1 if mixed >= 5 and 0.1 <= digits <= 0.9 else -1 if mixed <= 2 else 0,
        1 if spread >= 3.3 else -1 if spread < 2.8 else 0,
    )


LABELERS = 7
#: Hashed features of the span classifier.
DIMENSIONS = 1 << 12
#: Bound of its training sample: distinct candidates.
MOST_CANDIDATES = 20_000
ROUNDS, STEPS = 50, 300
PRIOR = 0.2


def features(text: str, start: int, end: int) -> list[int]:
    """What the span and its surroundings look like, without the labelers' verdicts."""
    span = text[start:end]
    shape = "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c for c in span)
    short = re.sub(r"(.)\1+", r"\1", shape)
    last = text[max(0, start - BEFORE) : start].rstrip(" =:\"'").split()[-1:]
    names = [
        f"length {min(len(span), 80) // 4}", f"changes {min(changes(span), 12)}", f"entropy {int(entropy(span) * 2)}",
        f"kinds {''.join(sorted(set(shape)))}", f"prefix {span[:4]}", f"before {last[0].lower()[-12:] if last else ''}",
        f"gap {text[max(0, start - 1) : start]}", f"after {text[end : end + 1]}", f"begins {short[:3]}", "any",
    ]
    return sorted({int(words.hashes([n.encode("utf-8", "surrogatepass")])[0] % DIMENSIONS) for n in names})


def reliabilities(pattern: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """By expectation-maximisation: probability of a secret per vote pattern, P(vote | class) per labeler, and the share of secrets.

    It starts from the majority of votes; each labeler votes independently given the class. Labelers are
    taken to be better than chance: each starts with PRIOR votes of its own side per candidate, so that a
    text collection with one sort of candidate only is not cut into two classes.
    """
    prior = PRIOR * count.sum() * np.array([[[0.6, 0.3, 0.1]], [[0.1, 0.3, 0.6]]])
    total = pattern.sum(axis=1)
    chance = np.where(total > 0, 0.9, np.where(total < 0, 0.1, 0.5))
    one_hot = np.stack([pattern == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(ROUNDS):
        weight = np.stack([(1 - chance) * count, chance * count])
        given = np.einsum("kp,plv->klv", weight, one_hot) + prior + 0.5
        given /= given.sum(axis=2, keepdims=True)
        share = (weight[1].sum() + 1) / (count.sum() + 2)
        log = np.einsum("plv,klv->kp", one_hot, np.log(given)) + np.log([[1 - share], [share]])
        chance = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return chance, given, float(share)


def classifier(rows: list[list[int]], chance: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on probabilities instead of labels, by gradient steps with momentum."""
    at = np.concatenate([np.array(r) for r in rows]).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, speed = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[at], len(rows)), -500, 500)))
        slope = np.bincount(at, (p - chance)[of], DIMENSIONS) / len(rows) + 1e-4 * w
        speed = 0.9 * speed - slope
        w += speed
    return w


@dataclass
class Model:
    weights: np.ndarray | None
    least: float = 0.5

    def secrets(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        if self.weights is None:
            return []
        ordered = sorted(base, key=lambda s: s[2])
        return [
            ("secret", a, b) for a, b in candidates(text, ordered)
            if 1 / (1 + math.exp(-max(-500.0, min(500.0, self.weights[features(text, a, b)].sum())))) >= self.least
        ]


def learn(docs: DataFrame, text_column: str = "text") -> Model:
    """The span classifier for ``docs``. Vote patterns are counted over all candidates of all texts, at most
    3^LABELERS of them come to the driver; the classifier is fitted on MOST_CANDIDATES distinct candidates,
    drawn by hash. Without candidates it adds nothing."""
    record = T.ArrayType(T.StructType([
        T.StructField("votes", T.ArrayType(T.IntegerType())), T.StructField("features", T.ArrayType(T.IntegerType())),
    ]))

    @F.pandas_udf(record)
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([
                [(votes(t, a, b), features(t, a, b)) for a, b in candidates(t, sorted(base_spans(t), key=lambda s: s[2]))] for t in batch
            ])

    seen = common.cut(
        docs.select(F.explode(judged(common.text_of(text_column))).alias("c")).groupBy("c.votes", "c.features").agg(F.count("*").alias("n"))
    )
    patterns = seen.groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    if not patterns:
        return Model(None)
    pattern = np.array([r["votes"] for r in patterns])
    chance, _, _ = reliabilities(pattern, np.array([r["n"] for r in patterns], float))
    by_votes = {tuple(p): c for p, c in zip(pattern.tolist(), chance, strict=True)}
    some = seen.orderBy(F.xxhash64("features", "votes"), "features", "votes").limit(MOST_CANDIDATES).collect()
    return Model(classifier([r["features"] for r in some], np.array([by_votes[tuple(r["votes"])] for r in some])))


def spans_of(model: Model, text: Column) -> Column:
    """Struct (base, added) of span arrays (kind, start, end), by start and kind; code points, end exclusive."""

    def both(t: str) -> tuple[list, list]:
        base = base_spans(t)
        return base, model.secrets(t, base)

    @F.pandas_udf(FOUND)
    def apply(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([both(t) for t in batch], columns=["base", "added"])

    return apply(F.coalesce(text.cast("string"), F.lit("")))


def find(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, base, added. Null texts count as empty and hold nothing; the whole text is read.

    An added span meets no base span. Repeated rows are searched each. Other columns are not looked at.
    """
    found = spans_of(model, F.col(f"`{text_column}`"))
    return docs.select(F.col(f"`{id_column}`").alias("id"), found.alias("f")).select("id", "f.base", "f.added")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    order = F.array(*map(F.lit, KINDS))
    ranked = lambda s: F.struct(s["start"], F.array_position(order, s["kind"]).alias("rank"), s["end"], s["kind"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = find(docs, learn(docs))
    return found.select(
        F.col("id").alias("doc_id"), *map(count, KINDS[:4]), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.transform(F.concat("base", "added"), ranked))).alias("spans"),
        F.size("added").cast("long").alias("n_secret"),
    )
