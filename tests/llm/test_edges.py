"""Nulls, empty and long texts, ties, repeated rows, empty tables, and columns whose names clash."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import common, decontaminate, exact_dedup, language_id, language_model, licenses, mixing, pii, quality, simhash, warc

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHES = "key digest _row _judged _found hash bucket class size words h bands prints node role chunk file at id found copy_no _Copy_Numbers kept".split()
ENGLISH = "The house on the hill was empty and the wind moved through the open door of it. "
LONG = " ".join(f"word{n % 5000} of" for n in range(60_000))
ROWS = [
    (1, ENGLISH, "en", "a", 1), (1, ENGLISH, "en", "a", 1), (2, ENGLISH.replace(" ", "\n"), "en", "b", 1), (None, ENGLISH, None, None, None),
    (3, None, "en", "a", None), (4, "", None, "b", 0), (5, " \t\n", "fr", None, 3), (6, LONG, "en", "a", len(LONG)), (7, "123 456", None, "a", 7),
    (None, None, None, None, None), (8, "un deux trois quatre cinq six sept huit", "fr", "b", 1), (9, "x", "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, COLUMNS)
    return df.select("*", *[F.lit(n).alias(c) for n, c in enumerate(CLASHES)])


def some(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def test_row_keys_tell_equal_rows_apart(odd):
    keyed, key = common.row_keyed(odd)
    assert key == "_row_" and keyed.select(key).distinct().count() == len(ROWS)
    again, _ = common.row_keyed(keyed.drop(key))
    assert again.columns[:-1] == odd.columns


def test_no_temporary_folder_on_a_cluster():
    class Nothing:
        master = "spark://host:7077"

        def __getattr__(self, name):
            return self

        def __call__(self, *args):
            return None if args and args[0] == "spark.checkpoint.dir" else self

        def isDefined(self):  # noqa: N802
            return False

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Nothing())


def test_exact(spark, odd):
    keyed, key = common.row_keyed(odd)
    rows = exact_dedup.decide(keyed, key).collect()
    assert len(rows) == len(ROWS)
    groups = {}
    for r in rows:
        groups.setdefault(r.digest, []).append(r)
    sizes = sorted(len(g) for g in groups.values())
    assert sizes == [1, 1, 1, 1, 4, 4]
    for own in groups.values():
        assert sum(r.kept for r in own) == 1 and {r.group_size for r in own} == {len(own)} and len({r.keep_id for r in own}) == 1
    assert {r.keep_id for g in groups.values() if len(g) == 4 for r in g} == {1, 5}  # longest text, then smallest id, null last
    assert exact_dedup.without_duplicates(odd).count() == 6


def test_near(spark, odd):
    keyed, key = common.row_keyed(odd)
    rows = simhash.near_groups(keyed, key, count=2).collect()
    assert len(rows) == len(ROWS)
    assert {r.component_id for r in rows if r.prints == [0, 0]} == {3}
    assert sum(r.stays for r in rows) == len({tuple(r.prints) for r in rows})
    with pytest.raises(ValueError):
        simhash.near_groups(keyed, key, radius=8)


def test_mix(spark, odd):
    keyed, key = common.row_keyed(odd)
    rows = mixing.copies(keyed, key).collect()
    assert len(rows) == len(ROWS) and all(r.taken == r.copies * r.size <= 2 * r.size for r in rows)
    assert {r.size for r in rows if r.id in (3, 4, 5)} == {0}
    out = mixing.mixed(odd)
    assert out.columns == [*odd.columns, "copy_no_"] and out.count() == sum(r.copies for r in rows)
    assert [tuple(r)[1:] for r in mixing.copies(keyed, key).orderBy("key").collect()] == [
        tuple(r)[1:] for r in mixing.copies(keyed.repartition(7), key).orderBy("key").collect()
    ]
    words_only = mixing.copies(*common.row_keyed(some(spark, [(1, "", "en", "a", 0), (2, None, "en", "b", 0)]))).collect()
    assert {r.target for r in words_only} == {0.0} and {r.taken for r in words_only} == {0}


def test_language(spark, odd):
    net = language_id.learn(odd)
    rows = odd.select("doc_id", "text", language_id.predicted(net, F.col("text")).alias("r")).collect()
    for r in rows:
        unknown = not r.text or not any(map(str.isalpha, r.text))
        assert (r.r.language == language_id.UNKNOWN) == unknown and (r.r.score == 0.0) == unknown
    assert {r.r.language for r in rows} <= {"en", "fr", "und"}
    kept = language_id.accepted(odd, odd)
    assert kept.columns == odd.columns
    nothing = odd.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.learn(nothing) is None and language_id.accepted(nothing, nothing).count() == 0


def test_pii(spark, odd):
    rows = pii.find(odd, pii.learn(odd)).collect()
    assert len(rows) == len(ROWS) and all(r.base == [] and r.added == [] for r in rows)
    hard = ["1" * 200_000, "a" * 200_000 + "@", "+" * 50_000, "1." * 50_000, "a@b" * 50_000]
    assert [len(pii.base_spans(t)) for t in hard] == [0, 0, 0, 12_500, 0]


def test_quality(spark, odd):
    rated = odd.withColumn("grade", F.when(F.col("doc_id") < 3, 2).when(F.col("doc_id") > 6, 7).otherwise(F.col("doc_id") % 2))
    model = quality.learn(rated, 3)
    rows = odd.select("text", quality.graded(model, F.col("text"), 3).alias("g")).collect()
    assert all((r.g.expected_grade is None) == (not (r.text or "").strip()) for r in rows)
    assert quality.learn(rated.withColumn("grade", F.lit(None).cast("int")), 3) is None
    assert odd.select(quality.graded(None, F.col("text"), 3).alias("g")).where("g.tail IS NOT NULL").count() == 0


def test_language_model(spark, odd):
    role = odd.withColumn("role", F.when(F.col("doc_id") == 7, None).otherwise(F.lit(1)))
    rows = language_model.scored(role, "role").collect()
    assert len(rows) == len(ROWS) and {r.n_tokens for r in rows if r.id in (3, 4, 5)} == {1}
    assert len({r.train_tokens for r in rows}) == 1 and all(r.score <= 0 for r in rows)
    nothing = language_model.scored(role.withColumn("role", F.lit(0)), "role").collect()
    assert {(r.score, r.base_score, r.n_known, r.train_tokens) for r in nothing} == {(0.0, 0.0, 0, 0)}


def test_contamination(spark, odd):
    items = spark.createDataFrame([(1, ENGLISH), (2, None), (None, ENGLISH), (3, "the"), (1, ENGLISH)], "item_id long, text string")
    rows = decontaminate.contamination(odd, items).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in rows) == [(0, 0), (0, 1), (1, 0), (1, 0), (1, 1), (1, 1), (2, 0), (2, 1)]
    assert all(r.similarity == 1.0 and r.start_word == 0 for r in rows)
    clean = decontaminate.decontaminated(odd, items)
    assert clean.columns == odd.columns and clean.count() == len(ROWS) - 4
    assert decontaminate.decontaminated(odd, items.limit(0)).count() == len(ROWS)


def test_contamination_in_several_passes(spark, odd, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", 2)
    items = spark.createDataFrame([(n, f"{ENGLISH} number {n}" if n else LONG[:400]) for n in range(5)], "item_id long, text string")
    texts = some(spark, [(n, f"x {ENGLISH} number {n} y", "en", "a", 1) for n in range(1, 5)])
    assert {(r.doc_id, r.item_id) for r in decontaminate.contamination(texts, items).where("similarity = 1").collect()} == {(n, n) for n in range(1, 5)}


def test_licenses(spark, odd):
    notice = odd.withColumn("text", F.when(F.col("doc_id") == 6, F.concat("text", F.lit(" Released under the MIT License"))).otherwise(F.col("text")))
    keyed, key = common.row_keyed(notice)
    assert [(r.id, r.template, r.start_word) for r in licenses.scan(keyed, key).collect()] == [(6, "MIT notice", 120_000)]
    assert licenses.scan(keyed, key, templates=(("tiny", "too short"),)).count() == 0


def test_archive(spark, tmp_path):
    pages = spark.createDataFrame([(None, None, None), (None, None, None), (1, "u", "a" * 1_000), (1, "u", "a" * 1_000)], "page_id long, url string, html string")
    warc.write(pages.withColumn("key", F.lit(1)).withColumn("address", F.lit(2)), str(tmp_path / "a"))
    rows = warc.read(spark, str(tmp_path / "a")).collect()
    assert sorted((r.id or 0, r.record_type, r.refers_to or 0) for r in rows) == [(0, "response", 0)] * 2 + [(1, "response", 0), (1, "revisit", 1)]
    warc.write(pages.limit(0), str(tmp_path / "b"))
    assert warc.read(spark, str(tmp_path / "b")).count() == 0


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    keyed, key = common.row_keyed(none)
    assert exact_dedup.decide(keyed, key).count() == 0
    assert simhash.near_groups(keyed, key).count() == 0
    assert mixing.copies(keyed, key).count() == 0
    assert licenses.scan(keyed, key).count() == 0
    assert pii.find(none, pii.learn(none)).count() == 0
    assert language_model.scored(none.withColumn("role", F.lit(1)), "role").count() == 0
    assert language_id.learn(none) is None
    assert quality.learn(none.withColumn("grade", F.lit(1)), 3) is None


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_tables(spark, odd, name, stage):
    last = name == corpus_pipeline.STAGES[-1][0]
    for docs in (odd, odd.limit(0), odd.select(*COLUMNS.replace(" long", "").replace(" string", "").split(", "))):
        out = stage(spark, docs, FOLDER)
        assert out.columns[: len(docs.columns)] == docs.columns and len(out.columns) == len(docs.columns) + last
        assert out.count() <= (2 if last else 1) * docs.count()


def test_pipeline_by_brute_force(spark):
    """Each stage on what its predecessor kept, against plain Python."""
    from tests.llm.test_near_copies import staying
    from tests.llm.test_operators import contained

    docs = common.table(spark, FOLDER, "documents")
    step = dict(corpus_pipeline.STAGES)
    before = {r.doc_id: r for r in docs.collect()}

    net = language_id.learn(docs.where(language_id.fold("doc_id", 5) != 0))
    want = {i for i, r in before.items() if (p := language_id.identify(net, r.text))[0] != "und" and p[1] >= language_id.LEAST_SCORE}
    docs = common.stored(step["language id"](spark, docs, FOLDER))
    now = {r.doc_id: r for r in docs.collect()}
    assert set(now) == want and len(now) > 0.95 * len(before)

    best = {}
    for i, r in now.items():
        text = "".join(c for c in r.text if c not in common.WHITE)
        best[text] = min(best.get(text, (0, i)), (-len(r.text), i))
    docs = common.stored(step["exact dedup"](spark, docs, FOLDER))
    now = {r.doc_id: r for r in docs.collect()}
    assert set(now) == {i for _, i in best.values()}

    want = staying({i: r.text for i, r in now.items()})
    assert len(want) < len(now)
    docs = common.stored(step["simhash near-dedup"](spark, docs, FOLDER))
    now = {r.doc_id: r for r in docs.collect()}
    assert set(now) == want

    items = [r.text for r in common.table(spark, FOLDER, "benchmark").collect()]
    docs = common.stored(step["benchmark decontamination"](spark, docs, FOLDER))
    want = {i for i, r in now.items() if all(contained(r.text, t) < 0.8 for t in items)}
    now = {r.doc_id: r for r in docs.collect()}
    assert set(now) == want

    out = step["mixing to target weights"](spark, docs, FOLDER).collect()
    size = {i: len((r.text or "").split()) for i, r in now.items()}
    assert all(tuple(r)[:-1] == tuple(now[r.doc_id]) for r in out)
    assert abs(sum(size[r.doc_id] for r in out) - 1.5 * sum(size.values())) < 0.1 * sum(size.values())
    assert [tuple(r) for r in corpus_pipeline.run(spark, FOLDER).orderBy("doc_id", "copy_no").collect()] == sorted(
        (tuple(r) for r in out), key=lambda r: (r[0], r[-1])
    )
