"""A lost driver at any step of a write, and the states that readers see."""

import pytest
from pyspark.sql import functions as F

from tallyspark.sources.tables import TableStore, changed_rows
from tests.conftest import rows

SCHEMA = "id string, date_key int, amount int"


class Lost(Exception):
    pass


def stop_at(monkeypatch, step):
    """Let the writes of a store pass until the given one, counted from 0, then lose the driver."""
    left = [step]

    def counted(name):
        real = getattr(TableStore, name)

        def call(self, *a, **k):
            if left[0] == 0:
                raise Lost
            left[0] -= 1
            return real(self, *a, **k)

        return call

    for name in ("aside", "_write_months", "_switch"):
        monkeypatch.setattr(TableStore, name, counted(name))


def frame(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def merge(store, df):
    store.merge_by_month(df, "core", "f", ["id"], "key")


def content(store):
    df = store.read("core", "f")
    return rows(df.select("id", "date_key", "amount", "load_month", "key"))


@pytest.mark.parametrize("step", range(4))
def test_merge_is_whole_or_not_at_all(spark, tmp_path, monkeypatch, step):
    store = TableStore(spark, str(tmp_path))
    merge(store, frame(spark, ("A", 20260115, 1), ("B", 20260116, 2), ("C", 20260201, 3), ("D", 20260305, 4)))
    before = content(store)
    key = {r[0]: r[4] for r in before}
    # A and C change places, B leaves its month, E is new
    load = frame(spark, ("A", 20260210, 1), ("C", 20260120, 3), ("B", 20260401, 2), ("E", 20260501, 5), ("D", 20260305, 4))
    with monkeypatch.context() as m:
        stop_at(m, step)
        with pytest.raises(Lost):
            merge(store, load)
    assert content(store) == before
    merge(store, load)
    want = [("A", 20260210, 1, 202602), ("B", 20260401, 2, 202604), ("C", 20260120, 3, 202601), ("D", 20260305, 4, 202603), ("E", 20260501, 5, 202605)]
    assert [r[:4] for r in content(store)] == want
    assert {r[0]: r[4] for r in content(store) if r[0] != "E"} == key and len({r[4] for r in content(store)}) == 5
    after = content(store)
    merge(store, load)
    assert content(store) == after


def test_a_month_that_lost_all_rows_is_gone(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    merge(store, frame(spark, ("A", 20260115, 1)))
    merge(store, frame(spark, ("A", 20260215, 1)))
    assert [r[:4] for r in content(store)] == [("A", 20260215, 1, 202602)]
    assert rows(store.read("core", "f").where("load_month = 202601")) == []


@pytest.mark.parametrize("step", range(1))
def test_replace_is_whole_or_not_at_all(spark, tmp_path, monkeypatch, step):
    store = TableStore(spark, str(tmp_path))
    store.replace(frame(spark, ("A", 1, 1)), "core", "d")
    with monkeypatch.context() as m:
        stop_at(m, step)
        with pytest.raises(Lost):
            store.replace(store.read("core", "d").withColumn("amount", F.lit(9)), "core", "d")
    assert rows(store.read("core", "d")) == [("A", 1, 1)]
    store.replace(store.read("core", "d").withColumn("amount", F.lit(9)), "core", "d")
    assert rows(store.read("core", "d")) == [("A", 1, 9)]


def test_readers_keep_the_state_they_opened(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    merge(store, frame(spark, ("A", 20260115, 1), ("B", 20260215, 2)))
    opened = store.read("core", "f")
    merge(store, frame(spark, ("A", 20260215, 7)))
    assert rows(opened.select("id", "amount")) == [("A", 1), ("B", 2)]
    for n in range(3):
        merge(store, frame(spark, ("A", 20260215, 10 + n)))
    assert rows(store.read("core", "f").select("id", "amount")) == [("A", 12), ("B", 2)]
    folders = [p.name for p in (tmp_path / "core" / "f").iterdir() if p.name.startswith("version=")]
    assert len(folders) <= 3


def test_a_plain_table_is_taken_over(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    old = frame(spark, ("A", 20260115, 1), ("B", 20260215, 2)).withColumn("key", F.col("amount").cast("long")).withColumn("load_month", F.floor(F.col("date_key") / 100).cast("int"))
    old.write.partitionBy("load_month").parquet(store.path("core", "f"))
    merge(store, frame(spark, ("A", 20260215, 5)))
    assert content(store) == [("A", 20260215, 5, 202602, 1), ("B", 20260215, 2, 202602, 2)]


def test_stored_twice_counts_as_changed(spark):
    stored = frame(spark, ("A", 1, 1), ("A", 1, 1), ("B", 1, 2), ("C", 1, None))
    load = frame(spark, ("A", 1, 1), ("B", 1, 2), ("C", 1, None), ("D", 1, 4))
    assert rows(changed_rows(load, stored, ["id"]).select("id")) == [("A",), ("D",)]
