"""Bounds that follow bytes or are no longer there: chunks of the language model, learned languages, versions of licenses."""

import random

from pyspark.sql import functions as F

from tallyspark.llm import common, language_id, language_model, licenses


def test_chunks_are_bounded_by_bytes(spark):
    draw = random.Random(1)
    rows = [(i, int(2 ** draw.uniform(0, 26)) if i % 3 else draw.choice([0, 1, 8191, 8192, 16384, 10**9])) for i in range(20_000)]
    df = spark.createDataFrame(rows, "at long, size long")
    chunk = language_model.chunk_of(F.col("at"), F.col("size")).alias("chunk")
    got = df.select("at", "size", chunk).groupBy("chunk").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    most = language_model.CHUNK_ROWS * language_model.SHORT_TEXT
    assert all(r.bytes <= most or r.n == 1 for r in got) and sum(r.n for r in got) == len(rows)
    small = df.where(F.col("size") < language_model.SHORT_TEXT).select(chunk).distinct().count()
    assert small == -(-20_000 // language_model.CHUNK_ROWS)


def test_every_language_is_learned(spark):
    names = [f"l{i:03}" for i in range(90)]
    texts = [(n, " ".join(chr(0x4E00 + 40 * i + (k + j) % 40) for j in range(30))) for i, n in enumerate(names) for k in range(3)]
    docs = spark.createDataFrame([*texts, (None, "abc"), ("empty", "123")], "lang string, text string")
    languages, cuts = language_id.sample(docs, "text", "lang")
    assert sorted(languages) == names and {n for n, _ in cuts} == set(names)
    assert language_id.learn(docs).languages == languages


def test_windows_per_language_shrink_with_their_number(spark, monkeypatch):
    monkeypatch.setattr(language_id, "WINDOWS", 12)
    docs = spark.createDataFrame([(f"l{i % 4}", f"word{i} other") for i in range(200)], "lang string, text string")
    languages, cuts = language_id.sample(docs, "text", "lang")
    per = [sum(n == x for n, _ in cuts) for x in languages]
    assert len(languages) == 4 and max(per) <= 3
    monkeypatch.setattr(language_id, "WINDOWS", 1)
    assert len({n for n, _ in language_id.sample(docs, "text", "lang")[1]}) >= 1


def test_versions_are_told_apart(spark):
    """Each version of a notice is found as itself only; with its version spoilt it is none of them."""
    gpl = "x y This work is licensed under the GNU General Public License, version {} and more"
    texts = [gpl.format(3), gpl.format(2), gpl.format("unknown"), f"{gpl.format(2)} {'w ' * 50} {gpl.format(3)}", "nothing here at all to see"]
    df, key = common.row_keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {(r.id, r.template) for r in licenses.scan(df, key).collect()}
    assert got == {(0, "GPL-3.0 notice"), (1, "GPL-2.0 notice"), (3, "GPL-2.0 notice"), (3, "GPL-3.0 notice")}
    assert len({name for name, _ in licenses.TEMPLATES}) == len(licenses.TEMPLATES) >= 50


def test_templates_from_a_table(spark):
    table = spark.createDataFrame([("own", "these seven words are a small template"), ("none", None), ("short", "too short")], "template string, text string")
    df, key = common.row_keyed(spark.createDataFrame([(1, "so: THESE seven words are a small template."), (2, None)], "doc_id long, text string"))
    assert [(r.id, r.template) for r in licenses.scan(df, key, templates=table).collect()] == [(1, "own")]
