import random

from pyspark.sql import functions as F

from tallyspark.operators.joins import join_split_hot_keys, left_join_spread_nulls, missing_from
from tallyspark.operators.latest import latest_per_key, pending_latest
from tallyspark.operators.upsert import assign_keys, keyed_rows, upsert
from tests.conftest import rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_against_brute_force(spark):
    rng = random.Random(7)
    data = [(f"k{rng.randrange(20)}", rng.choice([None, 1, 2, 3]), i) for i in range(300)]
    best = {}
    for k, at, i in data:
        rank = (at is not None, at or 0, i)
        if k not in best or rank > best[k][0]:
            best[k] = (rank, (k, at, i))
    df = spark.createDataFrame(data, "k string, at int, i int")
    assert rows(latest_per_key(df, ["k"], ["at", "i"])) == sorted(v[1] for v in best.values())


def test_latest_drops_versions_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"))
    plan = plan_of(latest_per_key(df, ["k"], ["at"]))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_only_pending_rows_count(spark):
    df = spark.createDataFrame([("a", 1, "pending"), ("a", 2, "invalid")], "k string, at int, record_status string")
    assert rows(pending_latest(df, ["k"], ["at"]).select("k", "at")) == [("a", 1)]


def test_keys_are_dense_stable_and_continue(spark):
    names = [f"id{i}" for i in range(500)]
    df = spark.createDataFrame([(n,) for n in names], "id string")
    first = assign_keys(df, ["id"], "key")
    got = dict((r.id, r.key) for r in first.collect())
    assert sorted(got.values()) == list(range(1, 501))
    assert dict((r.id, r.key) for r in assign_keys(df.repartition(7), ["id"], "key").collect()) == got

    more = spark.createDataFrame([(f"id{i}",) for i in range(400, 600)], "id string")
    later = dict((r.id, r.key) for r in keyed_rows(first, more, ["id"], "key").collect())
    assert all(later[n] == got[n] for n in names[400:])
    assert sorted(v for n, v in later.items() if n not in got) == list(range(501, 601))


def test_numbering_needs_no_single_partition_over_all_rows(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"))
    plan = plan_of(assign_keys(df, ["id"], "key"))
    main = plan.split("Subquery")[0]
    assert "SinglePartition" not in main


def test_only_keys_are_numbered(spark):
    """Below the windows that number rows there is no other column, and null and repeated keys lose no row."""
    old = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "key bigint, id string, wide string")
    new = spark.createDataFrame([("a", "A"), (None, "N"), ("b", "B"), ("b", "B2"), ("c", None)], "id string, wide string")
    for existing in (old, None):
        lines = keyed_rows(existing, new, ["id"], "key")._jdf.queryExecution().optimizedPlan().toString().split("\n")
        depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
        tops = [i for i, x in enumerate(lines) if x.lstrip(" :+-").startswith("Window")]
        assert tops
        for top in tops:
            below = [x for i, x in enumerate(lines[top + 1 :], top + 1) if all(depth[j] > depth[top] for j in range(top + 1, i + 1))]
            assert below and not any("Project" in x and "wide#" in x for x in below)
    got = keyed_rows(old, new, ["id"], "key").collect()
    number = {r.id: r.key for r in got}
    # a null key is never known, as in a join, so it is numbered anew
    assert len([r for r in got if r.id]) == 4 and number["a"] == 1 and sorted({r.key for r in got if r.key > 2}) == [3, 4, 5]
    assert len({r.key for r in keyed_rows(None, new, ["id"], "key").collect()}) == 4


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "x", "d1"), (2, "b", "y", "d1")], "key bigint, id string, v string, first_seen string")
    new = spark.createDataFrame([("b", "Y"), ("c", "Z")], "id string, v string")
    out = upsert(old, new, ["id"], "key", {"first_seen": F.lit("d2")})
    assert rows(out) == [(1, "a", "x", "d1"), (2, "b", "Y", "d1"), (3, "c", "Z", "d2")]
    again = upsert(out, new, ["id"], "key", {"first_seen": F.lit("d3")})
    assert rows(again) == rows(out)


def test_missing_from_keeps_null_keys_and_reads_history_once(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(2,), (3,), (None,)], "k int")
    assert rows(missing_from(left, right, ["k"])) == [(None,), (1,)]


def test_left_join_with_many_null_keys(spark):
    left = spark.createDataFrame([(i, None if i % 3 else i) for i in range(60)], "i int, k int")
    right = spark.createDataFrame([(i, f"n{i}") for i in range(0, 60, 2)], "rk int, name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = left_join_spread_nulls(left, right, "k", "rk", "i").select("i", "name")
        assert rows(got) == rows(left.join(right, left.k == right.rk, "left").select("i", "name"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(64 * 1024 * 1024))


def test_hot_key_join_against_plain_join(spark):
    left = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 150).cast("int").alias("k"), F.col("id").alias("v"))
    left = left.union(spark.createDataFrame([(None, -1)], "k int, v bigint"))
    right = spark.createDataFrame([(i, f"n{i}") for i in range(140)] + [(1, "twice")], "k int, name string")
    for how in ("inner", "left"):
        assert rows(join_split_hot_keys(left, right, "k", how, parts=4)) == rows(left.join(right, "k", how))


def test_whole_rows_are_numbered_alike_and_shuffled_once(spark):
    names = spark.createDataFrame([(f"id{i}" if i % 50 else None, i % 7, i) for i in range(300)], "id string, k int, n int")
    other = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "k int, place string")
    joined = names.join(other, "k")
    got, want = assign_keys(joined, ["id", "n"], "key", whole=True), assign_keys(joined, ["id", "n"], "key")
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert rows(got) == rows(want) and len(rows(got)) == joined.count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(assign_keys(joined, ["id", "n"], "key", whole=True))
        assert "ReusedExchange [__bucket" in plan and plan.count("REPARTITION_BY_COL") == 2  # one of them reused
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_the_hash_is_not_worked_out_for_a_null_check(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    assert "isnotnull(cast(conv" not in plan_of(assign_keys(df, ["id"], "key")).replace(" ", "")
