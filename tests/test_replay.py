"""Rejected rows, corrected and staged again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import warehouse_jobs as wj
from tallyspark.plans.replay import payload_cells, replay, still_rejected
from tallyspark.sources.ledger import BatchLedger
from tallyspark.sources.specs import ENTITIES
from tallyspark.sources.tables import TableStore
from tests.conftest import rows
from tests.test_warehouse_jobs import FILES, write

ROW = "source_row_identifier"


@pytest.fixture
def store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    for entity in ("customer", "product", "order"):
        batch = wj.ingest(store, entity, write(tmp_path / "in", entity, FILES[entity]), f"first-{entity}")
        wj.stage(store, entity, batch)
    return store


def corrections(store, entity, text):
    rejected = store.read("staging", entity).where("record_status = 'invalid'")
    return rejected.select(ROW, F.lit(text).alias("correction"))


def test_payloads_hold_the_source_cells(spark, store):
    for entity in ("customer", "product", "order"):
        spec = ENTITIES[entity]
        back = payload_cells(store.read("staging", entity).where("record_status = 'invalid'"), spec)
        source = store.read("raw", entity).join(back.select(F.col(ROW).alias("raw_id")), "raw_id")
        trimmed = [F.nullif(F.btrim(c), F.lit("")).alias(c) for c in spec.raw_columns]
        assert rows(back.select(*spec.raw_columns)) == rows(source.select(*trimmed)) != []


def test_odd_payloads(spark):
    spec = ENTITIES["product"]
    odd = spark.createDataFrame([("{",), ("",), (None,), ("[1]",), ('{"product_id": 7, "active": null, "more": 1}',)], "raw_payload string")
    cells = payload_cells(odd, spec).select("product_id", "active")
    assert sorted(map(tuple, cells.collect()), key=str) == sorted([("7", None)] + [(None, None)] * 4, key=str)


def test_replay_stages_corrected_rows_once(spark, store):
    change = corrections(store, "product", '{"active": "false"}')
    before = rows(store.read("staging", "product").select(ROW, "record_status"))
    assert replay(store, "product", "again", change) == (1, 0)
    assert replay(store, "product", "again", change)[0] == 0
    staged = store.read("staging", "product")
    assert rows(staged.where("ingestion_batch_id <> 'again'").select(ROW, "record_status")) == before
    new = staged.where("ingestion_batch_id = 'again'").collect()
    assert [(r.product_id, r.product_name, r.active, r.record_status, r.raw_payload) for r in new] == [("P2", "Jam", False, "pending", None)]
    assert new[0].source_row_identifier in {r[0] for r in before}
    assert rows(still_rejected(store).groupBy("source_table").count()) == [("customers", 1), ("orders", 1)]
    assert BatchLedger(store).state().where("batch_id = 'again'").first().status == "completed"
    # a second correction is a newer version of the row
    assert replay(store, "product", "once more", corrections(store, "product", '{"active": "true", "product_name": "Jelly"}')) == (1, 0)
    wj.load_dimensions(store, dt.date(2026, 7, 1), dt.date(2026, 12, 31))
    assert rows(store.read("core", "dim_product").select("product_id", "product_name"))[1] == ("P2", "Jelly")


def test_replay_that_breaks_a_rule_again(spark, store):
    assert replay(store, "customer", "no", corrections(store, "customer", '{"first_order_date": null, "total_spent": "-5"}')) == (0, 1)
    assert replay(store, "customer", "no", corrections(store, "customer", '{"first_order_date": null, "total_spent": "-5"}')) == (0, 0)
    errors = store.read("ops", "ingestion_errors").where("ingestion_batch_id = 'no'")
    assert [r.error_message for r in errors.collect()] != [] and store.read("staging", "customer").where("ingestion_batch_id = 'no'").count() == 0
    # without corrections all rejected rows meet the rules again; a correction that is no JSON changes nothing
    assert replay(store, "order", "same") == (0, 1)
    assert replay(store, "order", "broken", corrections(store, "order", "{")) == (0, 1)
    assert replay(store, "expense", "none") == (0, 0)


def test_a_replay_that_lost_its_driver_is_repeated(spark, store, monkeypatch):
    change = corrections(store, "product", '{"active": "true"}')
    with monkeypatch.context() as m:
        m.setattr("tallyspark.plans.replay.quarantine_rows", lambda _: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            replay(store, "product", "again", change)
    assert BatchLedger(store).state().where("batch_id = 'again'").first().status == "failed"
    assert replay(store, "product", "again", change)[0] == 0
    assert store.read("staging", "product").where("ingestion_batch_id = 'again'").count() == 1


def test_side_tables_have_own_names_and_go(spark, store, tmp_path):
    with store.sides():
        one = store.aside(spark.range(3), "core", "t__load")
        other = store.aside(spark.range(5), "core", "t__load")
        with store.sides():
            store.aside(spark.range(1), "core", "t__load")
        assert (one.count(), other.count()) == (3, 5)
        assert len(list((tmp_path / "store" / "core").iterdir())) == 2
    assert not list((tmp_path / "store" / "core").iterdir())
    replay(store, "product", "again")
    assert not [p.name for layer in (tmp_path / "store").iterdir() for p in layer.iterdir() if "__" in p.name]
