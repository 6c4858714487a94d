"""Digests of tables: additive, free of order, kept by folder and batch, against the full comparison."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.digests import added, change_of_latest, digests
from tallyspark.operators.latest import latest_per_key
from tallyspark.plans import table_digests as td
from tallyspark.plans import warehouse_jobs as wj
from tallyspark.sources.tables import TableStore
from tests.conftest import money, rows
from tests.test_kept_results import late
from tests.test_warehouse_jobs import FILES, WHEN, write

SCHEMA = "k string, amount decimal(14,2), part int"


def test_digests_add_up_in_any_order_and_tell_rows_apart(spark):
    draw = random.Random(3)
    data = [(draw.choice([None, "a", "b", f"k{i}"]), draw.choice([None, money("0"), money(f"{i}.25")]), i % 5) for i in range(300)]
    df = spark.createDataFrame(data, SCHEMA)
    whole = digests(df, "k", "amount").first()
    assert (whole.row_count, whole.total) == (300, sum(a for _, a, _ in data if a))
    draw.shuffle(data)
    parts = digests(spark.createDataFrame(data, SCHEMA).repartition(7), "k", "amount", ["part"])
    assert added(parts).first() == whole
    one = lambda *r: digests(spark.createDataFrame([(*x, 0) for x in r], SCHEMA), "k", "amount").first()
    m = money
    assert one(("a", m("1")), ("b", m("2"))) == one(("b", m("2")), ("a", m("1")))
    swapped = one(("a", m("2")), ("b", m("1")))
    assert swapped.total == one(("a", m("1")), ("b", m("2"))).total and swapped.digest != one(("a", m("1")), ("b", m("2"))).digest
    # repeated rows count, a null key is no text, a null amount is 0
    assert one(("a", m("1")), ("a", m("1"))).digest == 2 * one(("a", m("1"))).digest
    assert one((None, m("1"))).digest not in (one(("-", m("1"))).digest, one(("", m("1"))).digest)
    assert one(("a", None)) == one(("a", m("0")))
    empty = digests(df.limit(0), "k", "amount").first()
    assert (empty.row_count, empty.total, empty.digest) == (0, 0, 0)


def test_changes_of_the_latest_rows_add_up(spark):
    """Batches in any order of versions: the sum of the changes is the digest of the latest rows of all."""
    draw = random.Random(5)
    data = [(draw.choice([None, *"abcdefgh"]), money(draw.randrange(9)), draw.randrange(4), i) for i in range(120)]
    draw.shuffle(data)
    data = [(*row, n) for n, row in enumerate(data)]
    df = spark.createDataFrame(data, "k string, amount decimal(14,2), batch int, at int, place int")
    changes = [change_of_latest(df.where(F.col("batch") <= b), F.col("batch") == b, "k", "amount", ["at"]) for b in range(4)]
    total = changes[0]
    for change in changes[1:]:
        total = total.unionByName(change)
    full = digests(latest_per_key(df.where("k IS NOT NULL"), ["k"], ["at"]), "k", "amount")
    assert added(total).first() == full.first()
    # a batch with older versions only changes nothing
    old = spark.createDataFrame([("a", money("1"), 0, 5), ("a", money("7"), 1, 4)], "k string, amount decimal(14,2), batch int, at int")
    assert tuple(change_of_latest(old, F.col("batch") == 1, "k", "amount", ["at"]).first()) == (0, 0, 0)


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("digests")
    store = TableStore(spark, str(base / "store"))
    wj.run_all(store, {e: write(base / "in", e, lines) for e, lines in FILES.items()}, dt.date(2026, 7, 1), dt.date(2026, 12, 31))
    return store


def same_as_full(store):
    got = rows(td.validate_by_digests(store))
    assert got == rows(td.digest_report(wj.StoredTables(store)))
    return {r[0]: r for r in got}


def test_kept_digests_follow_loads(loaded, tmp_path):
    store = loaded
    first = same_as_full(store)
    assert first["fact_orders"][1:] == (2, 2, money("30"), money("30"), True, True)
    # a line of an unknown product is staged and never becomes a fact
    assert first["fact_sales"][1:3] == (3, 2) and first["fact_sales"][-2:] == (False, False)
    assert not any(td.refresh_months(store).values()) and not any(td.refresh_staged(store).values())

    later = "Sun Sep 06 2026 00:00:00 GMT+0600 (Bangladesh Standard Time)"
    batch = late(store, tmp_path, "order", [f"O1,{WHEN},C1,25,0,0,25,25,0,Delivered,Kim,{WHEN}", f"O7,{later},C2,7,0,0,7,7,0,Delivered,Kim,{later}"])
    # staged and not loaded: noticed
    assert not {r.fact_name: r.is_valid for r in td.validate_by_digests(store).collect()}["fact_orders"]
    wj.load_facts(store, ["fact_orders"], batches=[batch])
    read = td.refresh_months(store)
    assert {f for f, parts in read.items() if parts} == {"fact_orders"}
    assert sorted(p.rpartition("=")[2] for p in read["fact_orders"]) == ["202608", "202609"]
    assert same_as_full(store)["fact_orders"][1:] == (3, 3, money("42"), money("42"), True, True)

    # a month nobody rewrote is not read again
    batch = late(store, tmp_path / "more", "order", [f"O8,{later},C2,1,0,0,1,1,0,Delivered,Kim,{later}"])
    wj.load_facts(store, ["fact_orders"], batches=[batch])
    assert [p.rpartition("=")[2] for p in td.refresh_months(store)["fact_orders"]] == ["202609"]
    assert td.refresh_staged(store)["fact_orders"] == [batch]
    assert same_as_full(store)["fact_orders"][-1] is True


def test_swapped_amounts_are_noticed(loaded):
    store = loaded
    fact = store.read("core", "fact_orders")
    swap = F.when(F.col("order_id") == "O7", money("1")).when(F.col("order_id") == "O8", money("7")).otherwise(F.col("total_amount"))
    store.replace_months(fact.withColumn("total_amount", swap.cast("decimal(14,2)")), "core", "fact_orders")
    got = same_as_full(store)["fact_orders"]
    assert got[1] == got[2] and got[3] == got[4] and got[-2:] == (False, False)


def test_a_batch_that_grew_makes_the_digest_anew(loaded):
    store = loaded
    staged = store.read("staging", "expense")
    again = staged.where("record_status = 'pending'").withColumn("expense_id", F.lit("E9"))
    store.append(again, "staging", "expense", partition_by=["ingestion_batch_id", "record_status"])
    assert td.refresh_staged(store)["fact_expenses"]
    got = same_as_full(store)["fact_expenses"]
    assert got[1:3] == (3, 1) and got[-1] is False
