"""Phrases against a count of all n-grams in plain Python."""

import collections
import random
import re

import numpy as np
import pytest

from tallyspark.llm import collocations

COLUMNS = "lang string, text string, n long, phrase string, w1 string, size int, F int"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute(rows, longest=4, least=30, top=2_000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            own = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(own)
            for size in range(1, longest + 1):
                f[lang].update(tuple(own[i : i + size]) for i in range(len(own) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = collections.Counter()
        for p, a in candidates.items():
            for q in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}:
                longer[q] = max(longer[q], a)
        kept = []
        for p, a in candidates.items():
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            if p not in longer or 100 * longer[p] < 80 * a:
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 3) for r in rows], COLUMNS)


def found(spark, rows, **options):
    out = collocations.collocations(table(spark, rows), **options)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, out.collect()))


def made(draw, count):
    words = ["the", "of", "The", "new", "york", "city", "é", "ÉA", "x\x0by", "a\tb", "日本", "big", "apple", "rare%d"]
    rows = []
    for n in range(count):
        text = "".join(
            (draw.choice(["New York City", "the Big apple", "of the"]) if draw.random() < 0.4 else draw.choice(words).replace("%d", str(draw.randrange(500))))
            + draw.choice([" ", " ", "  ", "\t", ", ", "!", "\n", " . "])
            for _ in range(draw.randint(0, 60))
        )
        rows.append((draw.choice(["en", "en", "fr", None]), text))
    return rows


@pytest.mark.parametrize("longest,least,top,part", [(4, 30, 2_000, 1 << 22), (4, 12, 7, 40), (2, 5, 2_000, 300), (6, 9, 50, 1)])
def test_against_plain_counts(spark, monkeypatch, longest, least, top, part):
    monkeypatch.setattr(collocations, "AT_ONCE", part)
    rows = made(random.Random(longest), 150)
    want = brute(rows, longest, least, top)
    assert len(want) > 10
    texts = collocations.texts_of(table(spark, rows), "lang", "text")
    # in this process, where the length of a part can be changed: the words of all parts are the words of the texts
    for _, text in rows:
        data = lowered(text).encode()
        cut = [(p[:own], p[own:]) for p, own in collocations.parts(data, longest - 1)]
        assert b"".join(a for a, _ in cut) == data
    assert texts.count() == len(rows)
    assert found(spark, rows, longest=longest, least=least, top=top) == want


def test_windows_of_parts_are_those_of_the_whole(monkeypatch):
    data = b"\n".join(lowered(t).encode() for _, t in made(random.Random(8), 60))
    every = lambda h: np.ones(len(h), bool)

    def counted(size):
        monkeypatch.setattr(collocations, "AT_ONCE", size)
        total, sums = collections.Counter(), collections.Counter()
        for piece, own in collocations.parts(data, 3):
            part = collocations.Part(piece, own, "en")
            words = [*part.distinct.to_pylist(), None]
            columns, n = part.windows(every, 4)
            for *codes, m in zip(*columns, n, strict=True):
                total[tuple(words[c] for c in codes)] += int(m)
            for key, m in zip(*part.sums([1, 2, 3, 4]), strict=True):
                sums[int(key)] += int(m)
        return total, sums

    whole = counted(1 << 22)
    assert sum(whole[0].values()) == len(re.findall(rb"[^\x20\x09-\x0D.,;:!?]+", data))
    for size in (1, 7, 100, 1_000):
        assert counted(size) == whole


def test_crowded_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLOTS", 1 << 15)
    rows = made(random.Random(3), 120)
    assert found(spark, rows, least=4) == brute(rows, least=4)


def test_scores_of_huge_counts_are_exact(spark):
    a, left, right = 9 * 10**17 + 1, 9 * 10**17 + 3, 9 * 10**17 + 8
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").selectExpr(
        "CAST((2000000 * CAST(a AS decimal(20,0))) DIV (CAST(l AS decimal(20,0)) + CAST(r AS decimal(20,0))) AS long) AS score"
    ).first()
    assert row.score == 2_000_000 * a // (left + right)


def test_odd_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None), ("en", ""), ("en", " \t.,\n"), ("en", "word")]) == []
    long = [("en", "one two " * 30_000), ("en", "one two " * 30_000), (None, "alpha beta " * 40)]
    assert found(spark, long) == brute(long)
