"""Reports and views over all facts: what is shuffled of the lines, and that the rows stay those of the plain tables."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import reconcile
from tallyspark.operators.latest import latest_of_all_and_some, latest_per_key
from tallyspark.operators.upsert import assign_keys
from tallyspark.plans import table_digests
from tallyspark.plans.tpch_warehouse import LINE_STAGING, LINE_VERSION, SIMPLE_VERSION, TpchWarehouse
from tallyspark.plans.views import compose_view
from tallyspark.registered.warehouse_queries import _TIMES, VIEW_FACTS, _whole_view
from tests.conftest import rows

LINES = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double,"
    " l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
)
DAY = dt.datetime(2020, 1, 1)


def version_of(staging):
    return LINE_VERSION if staging in LINE_STAGING else SIMPLE_VERSION


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def write_tables(spark, folder):
    """Lines in several versions, with null keys and values, unknown products and orders; every table of the warehouse."""
    keys = [(o, n) for o in range(1, 30) for n in (1, 2)] + [(1, None), (None, 1), (None, None), (99, 1)]
    lines = [
        (o, 1000 if i == 5 else i % 7, i % 40, n, 1.5 + i + v, 100.25 * (i + 1), 0.07, None if i % 2 else 0.1, ("N", "A", "R", None)[(i + v) % 4],
         "OF"[(i // 2) % 2], None if i % 13 == 12 else DAY + dt.timedelta(days=v + i))
        for v in range(3) for i, (o, n) in enumerate(keys)
    ]
    frames = {
        "lineitem": (lines + lines[:9], LINES),
        "orders": ([(o, o % 9, "OFP"[o % 3], 10.5 * o, DAY + dt.timedelta(days=o), "1-URGENT") for o in range(1, 30)],
                   "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "customer": ([(c, f"c{c}", c % 25, 1.0, "BUILDING") for c in range(8)],
                     "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "part": ([(p, f"p{p}", "b", "PROMO", 3, 90.0 + p) for p in range(7)],
                 "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(s, f"s{s}", 1, s - 2.0) for s in range(40)], "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
        "nation": ([(n, f"n{n}", n % 5) for n in range(25)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(r, f"r{r}") for r in range(5)], "r_regionkey int, r_name string"),
        "events": ([(e, DAY + dt.timedelta(hours=e), e % 9, ("purchase", "error", "signup", "view", "click")[e % 5], 5.25 * e, '{"k": %d}' % (e % 100)) for e in range(150)],
                   "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"),
    }
    for name, (data, schema) in frames.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("shared") / "tables"
    write_tables(spark, base)
    return str(base)


@pytest.fixture()
def one_plan(spark):
    """The whole plan is made before it runs."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def plain(w):
    """The tables without those that only a derived warehouse brings."""
    return {n: w[n] for n in w if n.startswith(("stg_", "dim_", "fact_"))}


@pytest.mark.parametrize("report", [reconcile.warehouse_report, table_digests.digest_report])
def test_staged_lines_are_judged_from_the_shuffle_of_their_facts(spark, folder, report, one_plan):
    plan = plan_of(report(TpchWarehouse(spark, folder), version_of))
    assert plan.count("FileScan parquet [l_orderkey") <= 2  # lines, returned lines
    plan = plan_of(report(TpchWarehouse(spark, folder, together=True), version_of))
    assert plan.count("FileScan parquet [l_orderkey") == 1


@pytest.mark.parametrize("report", [reconcile.warehouse_report, reconcile.fact_report, table_digests.digest_report])
def test_reports_are_those_of_the_plain_tables(spark, folder, report):
    if report is reconcile.fact_report:  # it takes no other version than that of stores
        report = lambda t, version: reconcile._facts(t, version_of=version)
    w = TpchWarehouse(spark, folder)
    want = rows(report(plain(w), version_of))
    assert want == rows(report(w, version_of)) == rows(report(TpchWarehouse(spark, folder, together=True), version_of))


@pytest.fixture()
def no_broadcasts(spark, one_plan):
    """No table is small enough by its size alone."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def shuffled(plan):
    """What goes into each shuffle, one line of the plan each."""
    lines = plan.split("\n")
    return [a.split("Exchange ")[1] + " <- " + b for a, b in zip(lines, lines[1:]) if "Exchange hashpartitioning" in a and "Reused" not in a]


@pytest.mark.parametrize("view", ["v_sales", "v_returns", "v_return_items"])
def test_views_work_out_own_columns_after_their_joins(spark, folder, view, no_broadcasts):
    w = TpchWarehouse(spark, folder, together=view == "v_return_items")
    plan = plan_of(_whole_view(w, view))
    assert "v_return_items" != view or plan.count("FileScan parquet [l_orderkey") == 1
    for one in shuffled(plan):
        assert "date_key" not in one.split(" <- ")[0]  # days are broadcast
        assert not re.search(r"(gross_sales|line_total|line_amount|unit_price|cash_refund|return_status|source_table|source_row_identifier)#", one), one


@pytest.mark.parametrize("view", ["v_sales", "v_returns", "v_return_items"])
def test_views_have_the_rows_of_their_facts(spark, folder, view):
    w = TpchWarehouse(spark, folder)
    got, want = _whole_view(w, view), compose_view(w.with_keys(VIEW_FACTS[view]), view)
    assert got.columns == want.columns
    want = rows(want.withColumns({c: F.col(c).cast("string") for c in _TIMES if c in want.columns}))
    assert want == rows(got) == rows(_whole_view(TpchWarehouse(spark, folder, together=True), view)) and want


def test_latest_of_all_and_some_are_those_of_two_windows(spark):
    draw = random.Random(11)
    numbers = [None, 0.0, 1.0, 2.0, float("nan")]
    data = [(draw.choice([None, 1, 2, 3, 4, 5]), draw.choice([None, "x", "y"]), draw.choice(numbers), draw.choice(["N", "R", None])) for _ in range(200)]
    data += [(9, "x", 1.0, "N"), (9, "y", None, None)]  # none of them returned
    df = spark.createDataFrame(data, "k int, at string, n double, flag string")
    every, some = latest_of_all_and_some(df, ["k"], ["at", "n", "flag"], F.col("flag") != "N")
    text = lambda t: rows(t.select(*[F.col(c).cast("string") for c in df.columns]))
    assert text(every) == text(latest_per_key(df, ["k"], ["at", "n", "flag"]))
    assert text(some) == text(latest_per_key(df.where("flag <> 'N'"), ["k"], ["at", "n", "flag"]))


def test_a_hot_line_leaves_each_task_as_one_row_for_both_tables(spark, one_plan):
    df = spark.range(0, 4000, 1, 4).select(F.lit(1).alias("k"), F.col("id").alias("at"))
    every, some = latest_of_all_and_some(df, ["k"], ["at"], F.col("at") % 2 == 0)
    plan = plan_of(every.union(some))
    assert "partial_max" in plan and "ReusedExchange" in plan and rows(every.union(some)) == [(1, 3998), (1, 3999)]


def test_bucket_starts_are_joined_in_the_plan_of_the_rows(spark, one_plan):
    df = spark.range(50).select(F.concat(F.lit("id"), F.col("id")).alias("id"), F.col("id").alias("n"))
    got = assign_keys(df, [F.concat("id", F.lit("")), "n"], "key", whole=True)
    assert "Subquery" not in plan_of(got)  # one would be planned apart and share no shuffle
    assert rows(got) == rows(assign_keys(df, ["id", "n"], "key"))
