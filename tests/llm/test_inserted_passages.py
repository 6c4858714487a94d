"""Benchmark passages with words put in, taken out or changed, against a lookup of all shingles of all stretches."""

import random

import pytest

from tallyspark.llm import decontaminate
from tests.llm.test_operators import contained


def brute(text, item):
    """Largest share of the item's shingles in a stretch of at most STRETCH times its words."""
    own, size = text.split(), int(decontaminate.STRETCH * len(item.split()))
    return max(contained(" ".join(own[n : n + size]), item) for n in range(max(1, len(own) - size + 1)))


def planted(draw, length, put=0, blocks=1, out=0, changed=0):
    """A text that holds an item changed by inserted blocks of ``put`` words, one block of ``out`` removed words, and changed words."""
    some = lambda n, w="w": [f"{w}{draw.randrange(5_000)}" for _ in range(n)]
    item = some(length)
    own = list(item)
    for place in draw.sample(range(length), changed):
        own[place] = some(1, "z")[0]
    if out:
        start = draw.randrange(5, length - out - 5)
        own[start : start + out] = []
    for _ in range(blocks if put else 0):
        place = draw.randrange(5, len(own) - 5)
        own[place:place] = some(put, "x")
    return " ".join(item), " ".join([*some(draw.randrange(100), "y"), *own, *some(draw.randrange(100), "y")])


KINDS = {
    "inserted blocks": [(40, 5), (60, 8), (100, 20), (200, 40), (150, 60)],
    "inserted words": [(26, 1), (60, 1, 2), (100, 1, 4), (30, 2)],
    "removed": [(60, 0, 0, 4), (200, 0, 0, 20), (100, 0, 0, 15)],
    "changed": [(30, 0, 0, 0, 1), (60, 0, 0, 0, 2), (200, 0, 0, 0, 6), (400, 0, 0, 0, 10)],
}


@pytest.mark.parametrize("name", KINDS)
def test_recall_of_changed_passages(name):
    draw = random.Random(name)
    cases = [planted(draw, *kind) for kind in KINDS[name] for _ in range(40)]
    index = decontaminate.Index([(n, item) for n, (item, _) in enumerate(cases)])
    found = index.matches([text for _, text in cases])
    want = [brute(text, item) >= 0.8 for item, text in cases]
    hit = [w and n in [m[0] for m in own] for n, (w, own) in enumerate(zip(want, found, strict=True))]
    assert sum(want) > 60 and sum(hit) >= 0.9 * sum(want)
    for n, ((item, text), own) in enumerate(zip(cases, found, strict=True)):
        for i, start, end, _ in own:
            assert i == n and end - start <= 1.5 * len(item.split())
            assert contained(" ".join(text.split()[start:end]), item) >= 0.8


def test_places_of_whole_passages():
    index = decontaminate.Index([(1, "a b c d e f g h"), (2, "k l m n o p")])
    assert index.matches(["z z a b c d e f g h z", "a b c d e f g h a b c d e f g h k l m n o p", "a b c d", "e f g h"]) == [
        [(1, 2, 10, 1.0)], [(1, 0, 8, 1.0), (2, 16, 22, 1.0)], [], []
    ]


def test_items_shorter_than_a_shingle():
    index = decontaminate.Index([(1, "What now?"), (2, "word"), (3, "a b c d e f"), (4, "what NOW")])
    assert index.matches(["What, now", "a b c d e f word", "so what now", "word", ""]) == [
        [(1, 0, 2, 1.0), (4, 0, 2, 1.0)], [(3, 0, 6, 1.0)], [], [(2, 0, 1, 1.0)], []
    ]


def test_repeated_passages():
    item = " ".join(f"w{n}" for n in range(60))
    index = decontaminate.Index([(1, item)])
    assert [[m[0] for m in own] for own in index.matches([f"{item} {item}", f"x {item} {item} {item} y", " ".join([item] * 20)])] == [[1], [1], [1]]


def test_shingles_far_apart_or_out_of_order_are_no_passage():
    item = [f"w{n}" for n in range(200)]
    pieces = [item[n : n + 20] for n in range(0, 200, 20)]
    index = decontaminate.Index([(1, " ".join(item))])
    far = [w for n, p in enumerate(pieces) for w in [*p, *[f"x{n}-{k}" for k in range(200)]]]
    draw = random.Random(3)
    draw.shuffle(pieces)
    scattered = [w for n, p in enumerate(pieces) for w in [*p, *[f"x{n}-{k}" for k in range(200)]]]
    shuffled = [w for p in pieces for w in p]
    assert index.matches([" ".join(t) for t in (far, scattered, shuffled)]) == [[], [], []]


def test_similarity_does_not_depend_on_blocks(spark, monkeypatch):
    draw = random.Random(5)
    shared = [f"s{n}" for n in range(30)]
    items = [(n, " ".join([*shared, *[f"w{n}-{k}" for k in range(30)]])) for n in range(6)]
    changed = [(n, " ".join(w if draw.random() > 0.03 else "zzz" for w in text.split())) for n, text in items]
    docs = spark.createDataFrame([(n, f"before it {t} after it") for n, t in changed], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    results = []
    for size in (1, 4, 100):
        monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", size)
        results.append(sorted(map(tuple, decontaminate.contamination(docs, table).collect())))
    assert results[0] == results[1] == results[2] and len(results[0]) >= 3
