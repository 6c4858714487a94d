"""The near stage against the exact Jaccard similarity of all pairs."""

import random

import numpy as np

import corpus_pipeline
from tallyspark.llm import common, near_copies

FOLDER = "/root/testdata/sf0.01"


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def shingles(text):
    own = (text or "").lower().split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def staying(texts, least=0.8):
    """The smallest id of each group, by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    holders, head = {}, {i: i for i in texts}
    for i in sorted(sets):
        for s in sets[i] or {None}:
            holders.setdefault(s, []).append(i)

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    seen = {(a, b) for own in holders.values() for n, b in enumerate(own) for a in own[:n]}
    for a, b in seen:
        if similarity(sets[a], sets[b]) >= least:
            low, high = sorted((top(a), top(b)))
            head[high] = low
    return {i for i in texts if head[i] == i}


def stayed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id for r in corpus_pipeline.near(spark, df, FOLDER).collect()}


def edited(draw, own, at_least, at_most):
    """``own`` with words replaced, scattered or in one block, until its similarity lies in the range."""
    while True:
        out, n = list(own), draw.randint(1, max(1, len(own) // 6))
        start = draw.randrange(len(own) - n)
        for place in range(start, start + n) if draw.random() < 0.5 else draw.sample(range(len(own)), n):
            out[place] = f"x{draw.randrange(10**6)}"
        if at_least <= similarity(shingles(" ".join(own)), shingles(" ".join(out))) < at_most:
            return out


def test_pairs_on_both_sides_of_the_threshold(spark):
    draw = random.Random(5)
    texts = {}
    for n in range(120):
        own = [f"w{draw.randrange(4_000)}" for _ in range(draw.choice([60, 150, 400, 1_500]))]
        texts[2 * n] = " ".join(own)
        texts[2 * n + 1] = " ".join(edited(draw, own, *((0.8, 0.84) if n % 2 else (0.74, 0.8))))
    want = staying(texts)
    assert len(want) == 180
    assert stayed(spark, list(texts.items())) == want


def test_dense_group_with_a_common_passage(spark):
    draw = random.Random(6)
    whole = [f"w{draw.randrange(4_000)}" for _ in range(120)]
    texts = {n: " ".join(edited(draw, whole, 0.6, 0.95)) for n in range(200)}
    texts |= {n: " ".join([*whole[:50], *[f"y{draw.randrange(10**6)}" for _ in range(80)]]) for n in range(200, 300)}
    want = staying(texts)
    assert 100 < len(want) < 290
    assert stayed(spark, list(texts.items())) == want


def test_texts_of_few_words_and_none(spark):
    rows = [(3, None), (4, ""), (5, " \n"), (6, "one"), (7, "One"), (8, "one two"), (9, "one two three four five"), (10, "one  two three four FIVE")]
    assert stayed(spark, rows) == {3, 6, 8, 9}
    assert stayed(spark, []) == set()


def test_near_stage_by_exact_similarity(spark):
    docs = corpus_pipeline.exact(spark, common.table(spark, FOLDER, "documents"), FOLDER)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id for r in corpus_pipeline.near(spark, docs, FOLDER).collect()}
    want = staying(texts)
    assert len(want) < len(texts) and got == want


def test_parities_differ_in_no_more_places_than_the_sets():
    draw = np.random.default_rng(1)
    for n in (0, 1, 50, 3_000):
        one, other = (draw.integers(0, 1 << 63, n, np.uint64) for _ in range(2))
        other[: n // 2] = one[: n // 2]
        apart = np.bitwise_count(near_copies.parities(one) ^ near_copies.parities(other)).sum()
        assert apart <= len(np.setxor1d(one, other))


def test_candidates_by_simhash(spark):
    """Without any common band, documents whose SimHashes differ in at most three bits are compared."""
    rows = [(0, [], 0), (1, [], 0b111), (2, [], 0b1111), (3, [], -1), (4, [], None)]
    groups = spark.createDataFrame(rows, "node long, keys array<long>, print long")
    nodes = groups.selectExpr("node", "10L AS size", "array_repeat(0L, 16) AS odd")
    indexed = near_copies.index(groups)
    roots = spark.createDataFrame([], "node long, root long")
    stars = {(r.a, r.b) for r in near_copies.star_pairs(indexed, nodes, 0.8).collect()}
    pairs = {(r.a, r.b) for r in near_copies.pairs_between(indexed, nodes, roots, 0.8).collect()}
    assert pairs == {(1, 0), (2, 1)}
    assert stars <= pairs


def test_fingerprint_of_the_sketch(spark):
    from tallyspark.llm import simhash

    df = spark.createDataFrame([("one two three four five six",), (None,)], "text string")
    got = [r.p for r in df.select(near_copies.sketches(df.text, 5)[3].alias("p")).collect()]
    assert got == [int(simhash.fingerprints(t, 1, distinct=True).view(np.int64)[0]) for t in ("one two three four five six", None)]
