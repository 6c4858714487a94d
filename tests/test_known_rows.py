"""Rows ingested before, by filters, against the anti join over the whole history."""

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import warehouse_jobs as wj
from tallyspark.sources import known_rows
from tallyspark.sources.tables import TableStore
from tests.conftest import rows
from tests.test_latest_and_keys import plan_of
from tests.test_warehouse_jobs import write


def hashed(spark, start, end, batch=None):
    df = spark.range(start, end).select(F.sha2(F.col("id").cast("string"), 256).alias(known_rows.HASH))
    return df.withColumn(known_rows.BATCH, F.lit(batch) if batch else F.concat(F.lit("b"), F.abs(F.xxhash64(known_rows.HASH)) % 5))


@pytest.mark.parametrize("bits", [1 << 30, 40_000, 3_000, 1])
def test_filters_never_miss_and_raw_decides(spark, bits):
    """Few bits force false positives, up to all rows; the result stays that of the anti join."""
    raw, load = hashed(spark, 0, 1_500), hashed(spark, 1_200, 2_400).drop(known_rows.BATCH)
    filters = known_rows.filters_of(raw, bits)
    known = known_rows.known_rows_by_filter(load, raw, filters, bits=bits)
    assert rows(known) == rows(load.join(raw, known_rows.HASH, "left_semi"))
    maybe = known_rows.not_ruled_out(load, filters, bits)
    passed = maybe.select(known_rows.HASH).distinct().count()
    assert passed == {1 << 30: 300, 1: 1_200}.get(bits, passed) and 300 <= passed <= 1_200
    true = raw.join(load, known_rows.HASH, "left_semi").select(known_rows.HASH, known_rows.BATCH)
    assert true.exceptAll(maybe).count() == 0


def numbers(store, entity="expense"):
    return sorted(int(r[0].removeprefix("E")) for r in store.read("raw", entity).select("expense_id").collect())


def lines(*ids):
    return [f"E{n},08/15/2026,,tea,${n + 1}.50,,K1,Kim,,Kim,2026-08-15" for n in ids]


def ingest(store, folder, name, ids, batch):
    return wj.ingest(store, "expense", write(folder / name, "expense", lines(*ids)), batch)


@pytest.fixture
def store(spark, tmp_path, monkeypatch):
    spec = wj.ENTITIES["expense"]
    assert spec.skip_known_rows
    return TableStore(spark, str(tmp_path / "store"))


def test_batches_add_only_new_rows(spark, store, tmp_path, monkeypatch):
    ingest(store, tmp_path, "a", [1, 2, 3, 3], "7")
    assert numbers(store) == [1, 2, 3]
    ingest(store, tmp_path, "b", [3, 4], "a b/c")
    ingest(store, tmp_path, "c", [1, 4, 5], "8")
    assert numbers(store) == [1, 2, 3, 4, 5]
    assert store.parts_by("raw", "expense", known_rows.BATCH) == {"7", "a b/c", "8"}
    # a batch named like a number stays text, and a filter on it reads its folder only
    own = store.read("raw", "expense").where("ingestion_batch_id = '7'")
    assert own.count() == 3 and len(own.inputFiles()) and "PartitionFilters: [isnotnull(ingestion_batch_id" in plan_of(own)
    # a batch loaded once more with further rows: its filter is made anew
    ingest(store, tmp_path, "d", [2, 6], "7")
    ingest(store, tmp_path, "e", [1, 2, 3, 4, 5, 6, 7], "9")
    assert numbers(store) == [1, 2, 3, 4, 5, 6, 7]
    received = store.read("raw", "expense").groupBy("ingestion_batch_id").count()
    assert dict(rows(received)) == {"7": 4, "a b/c": 1, "8": 1, "9": 1}


def test_a_load_of_new_rows_reads_no_history(spark, store, tmp_path, monkeypatch):
    ingest(store, tmp_path, "a", [1, 2], "one")
    ingest(store, tmp_path, "b", [3], "two")
    asked = []
    real = known_rows.missing_from
    monkeypatch.setattr(known_rows, "missing_from", lambda *a: asked.append(a) or real(*a))
    ingest(store, tmp_path, "c", [4, 5], "three")
    assert asked == [] and numbers(store) == [1, 2, 3, 4, 5]
    ingest(store, tmp_path, "d", [1, 6], "four")
    assert len(asked) == 1 and numbers(store) == [1, 2, 3, 4, 5, 6]
    files = asked[0][1]._jdf.queryExecution().executedPlan().toString()
    assert "ingestion_batch_id" in files and "one" in files and "two" not in files
