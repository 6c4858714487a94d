import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import reconcile
from tallyspark.plans import warehouse_jobs as wj
from tallyspark.plans.facts import unresolved_rows
from tallyspark.plans.metric_query import MetricRequest, metric_query
from tallyspark.plans.views import SUMMARY, register_views
from tallyspark.sources.csv_source import MissingColumns, has_quoted_line_breaks, read_export, row_hash
from tallyspark.sources.ledger import BatchLedger
from tallyspark.sources.specs import ENTITIES
from tallyspark.sources.tables import TableStore
from tallyspark.streaming.ingest_stream import ingest_stream
from tests.conftest import money, rows

WHEN = "Sat Aug 15 2026 00:00:00 GMT+0600 (Bangladesh Standard Time)"
BOM = "﻿"
FILES = {
    "customer": ["C1,Ann,,,,,1,2,3,4,Active", "C2,Bob,,,2026-02-01,2026-01-01,1,2,3,4,Active"],
    "product": ["P1,Nuts,Food,kg,10,6,5,1,true", "P2,Jam,Food,jar,4,2,5,1,maybe"],
    "partner": ["R1,Kim,Owner,true"],
    "supplier": ["S1,Mill,,,true", "S2,Old,,,false"],
    "stock_location": ["L1,Shop,store,R1,true", "L2,Shed,store,R9,true"],
    "cash_account": ['K1,Till,Cash,R1,true,"1,000",0,1000'],
    "order": [f"O1,{WHEN},C1,20,0,0,20,20,0,Delivered,Kim,{WHEN}", f"O2,{WHEN},,10,0,0,10,0,10,,Kim,{WHEN}", f",{WHEN},C1,1,0,0,1,1,0,x,y,{WHEN}"],
    "order_item": ["I1,O1,P1,2,10,6,0,20,12,L1", "I2,O2,P1,1,10,6,1,,,L2", "I3,O2,P9,1,10,6,0,10,6,L1"],
    "payment": [f"Y1,{WHEN},O1,C1,20,Cash,K1,Kim,\"two\nlines, \"\"quoted\"\"\",{WHEN}", f"Y2,{WHEN},O1,C1,0,Cash,K1,Kim,,{WHEN}"],
    "purchase": [f"B1,{WHEN},S1,$60,0,0,\"$1,060\",60,0,Cash,K1,Kim,Done,,{WHEN}", f"B2,{WHEN},S2,60,0,0,60,60,0,Cash,K1,Kim,Done,,{WHEN}"],
    "purchase_item": ["BI1,B1,P1,10,6,0,60,L1", "BI2,B2,P1,10,6,0,60,L1"],
    "return": [f"T1,{WHEN},customer_return,O1,,L1,5,K1,Kim,,Done,,{WHEN}", f"T2,{WHEN},customer_return,O1,B1,L1,5,K1,Kim,,Done,,{WHEN}"],
    "return_item": ["TI1,T1,P1,1,5,"],
    "stock_movement": [f"M1,{WHEN},P1,PURCHASE,B1,10,IN,,L1,,{WHEN}", f"M2,{WHEN},P1,SALE,O1,(2),OUT,L1,,,{WHEN}"],
    "cash_transaction": [f"X1,{WHEN},K1,IN,PAYMENT,Y1,20,,Kim,{WHEN}", f"X2,{WHEN},K1,OUT,EXPENSE,E1,7.5,,Kim,{WHEN}"],
    "expense": [f"E1,08/15/2026,,tea,$7.50,,K1,Kim,,Kim,{WHEN}", f"E2,08/15/2026,,tea,(1),,K1,Kim,,Kim,{WHEN}"],
    "partner_capital": [f"Q1,{WHEN},CAPITAL,R1,K1,500,,,Kim,{WHEN}"],
}


def write(folder, entity, lines, header=None):
    spec = ENTITIES[entity]
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"{spec.file}.csv"
    path.write_text(BOM + "\n".join([header or ",".join(spec.header), *lines]) + "\n", encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("wh")
    store = TableStore(spark, str(base / "store"))
    exports = {e: write(base / "in", e, lines) for e, lines in FILES.items()}
    wj.run_all(store, exports, dt.date(2026, 7, 1), dt.date(2026, 12, 31))
    return store, base


def test_rejected_rows_are_quarantined_with_their_text(loaded):
    store, _ = loaded
    errors = store.read("ops", "ingestion_errors")
    assert rows(errors.select("source_table", "error_type", "error_message")) == [
        ("customers", "validation_error", "first_order_date cannot be later than last_order_date."),
        ("orders", "validation_error", "order_id is required."),
        ("payments", "validation_error", "amount must be greater than zero."),
        ("products", "transform_error", "active could not be read as boolean."),
    ]
    assert '"active":"maybe"' in errors.where("source_table = 'products'").first().raw_payload
    assert rows(store.read("staging", "order").groupBy("record_status").count()) == [("invalid", 1), ("pending", 2)]


def test_facts(loaded):
    store, _ = loaded
    t = wj.StoredTables(store)
    sales = t["fact_sales"].select("order_item_id", "line_total", "gross_sales", "cogs", "customer_key")
    customer = t["dim_customer"].first().customer_key
    assert rows(sales) == [("I1", money("20.00"), money("20.00"), money("12.00"), customer), ("I2", money("9.00"), money("10.00"), money("6.00"), None)]
    assert rows(unresolved_rows("fact_sales", t)) == [("I3",)]
    assert rows(unresolved_rows("fact_purchases", t)) == [("BI2",)]
    assert t["fact_orders"].where("order_id = 'O2'").first().order_status == "unknown"
    assert rows(t["fact_return_items"].select("line_amount", "returned_cogs")) == [(money("5.00"), money("6.00"))]
    assert rows(t["fact_returns"].select("return_type", "cash_refund")) == [("CUSTOMER_RETURN", money("5.00"))]
    assert t["fact_expenses"].first().expense_category == "uncategorized"
    assert rows(t["dim_location"].select("stock_location_id", F.col("partner_key").isNotNull())) == [("L1", True), ("L2", False)]
    broken = store.read("ops", "constraint_violations").select("table_name", "business_key", "error_message")
    assert rows(broken) == [
        ("fact_expenses", "E2", "amount must be greater than zero."),
        ("fact_returns", "T2", "return reference does not fit return_type."),
        ("fact_stock_movements", "M2", "quantity must be greater than zero."),
    ]
    notes = t["fact_payments"].first().notes
    assert notes == 'two\nlines, "quoted"'


def test_ledger(loaded):
    store, _ = loaded
    state = BatchLedger(store).state()
    assert rows(state.select("status").distinct()) == [("completed",)]
    assert state.where("source_name = 'orders'").first().records_loaded == 3


def test_reports_and_views(loaded, spark):
    store, _ = loaded
    t = wj.StoredTables(store)
    report = {r.fact_name: (r.expected_count, r.actual_count, r.is_valid) for r in reconcile.fact_report(t).collect()}
    assert report["fact_orders"] == (2, 2, True) and report["fact_sales"] == (3, 2, False)
    totals = {r.metric_name: r.difference for r in reconcile.totals_report(t).collect()}
    assert totals["order_total_amount"] == 0 and totals["purchase_line_total"] == money("60.00")
    assert rows(reconcile.warehouse_report(t).where("check_group = 'all'").select("is_valid")) == [(False,)]
    assert SUMMARY in register_views(t)
    assert spark.sql("SELECT sum(gross_sales) FROM v_sales").first()[0] == money("30.00")
    assert rows(metric_query(t, MetricRequest(["gross_sales", "total_purchases", "cash_in"]))) == [(money("30.00"), money("60.00"), money("20.00"))]


def test_loading_again_changes_nothing(loaded):
    store, base = loaded
    t = wj.StoredTables(store)
    before = {n: rows(t[n].drop("valid_from")) for n in ("fact_sales", "fact_orders", "dim_customer", "dim_location")}
    batch = wj.ingest(store, "order", str(base / "in" / "Orders.csv"))
    assert BatchLedger(store).state().where(F.col("batch_id") == batch).first().records_loaded == 0
    for entity in FILES:
        wj.stage(store, entity)
    wj.load_dimensions(store, dt.date(2026, 7, 1), dt.date(2026, 12, 31))
    wj.load_facts(store)
    assert {n: rows(t[n].drop("valid_from")) for n in before} == before
    assert store.read("ops", "constraint_violations").count() == 3
    assert store.read("ops", "ingestion_errors").count() == 4


def test_a_changed_row_moves_to_its_new_month(loaded):
    store, base = loaded
    key = wj.StoredTables(store)["fact_expenses"].first().expense_key
    path = write(base / "later", "expense", [f"E1,09/02/2026,Rent,tea,8,,K1,Kim,,Kim,{WHEN}", f"E3,2026-10-01,Rent,,3,,,Kim,,Kim,{WHEN}"])
    batch = wj.ingest(store, "expense", path)
    wj.stage(store, "expense", batch)
    wj.load_facts(store, only=["fact_expenses"], batches=[batch])
    got = wj.StoredTables(store)["fact_expenses"].select("expense_key", "expense_id", "date_key", "amount", "load_month")
    assert rows(got) == [(key, "E1", 20260902, money("8.00"), 202609), (key + 1, "E3", 20261001, money("3.00"), 202610)]


def test_lines_follow_their_changed_order(loaded):
    store, base = loaded
    path = write(base / "later", "order", ["O1,2026-11-05,C1,20,0,0,20,20,0,Delivered,Kim,"])
    batch = wj.ingest(store, "order", path)
    wj.stage(store, "order", batch)
    before = rows(wj.StoredTables(store)["fact_sales"].select("sales_key", "order_item_id"))
    wj.load_facts(store, only=["fact_orders", "fact_sales"], batches=[batch])
    t = wj.StoredTables(store)
    assert rows(t["fact_sales"].select("order_item_id", "date_key")) == [("I1", 20261105), ("I2", 20260815)]
    assert rows(t["fact_sales"].select("sales_key", "order_item_id")) == before
    everything = {n: rows(t[n]) for n in ("fact_orders", "fact_sales")}
    wj.load_facts(store)
    assert {n: rows(t[n]) for n in everything} == everything


def test_missing_columns(spark, tmp_path):
    path = write(tmp_path, "partner", ["R1,Kim,true"], header="Partner_ID,Partner_Name,Active")
    with pytest.raises(MissingColumns):
        read_export(spark, path, ENTITIES["partner"])
    lax = read_export(spark, path, ENTITIES["partner"], strict=False)
    assert rows(lax.select("partner_id", "role", "active", "source_row_number")) == [("R1", None, "true", 2)]
    store = TableStore(spark, str(tmp_path / "store"))
    with pytest.raises(MissingColumns):
        wj.ingest(store, "partner", path)
    failed = BatchLedger(store).state().first()
    assert failed.status == "failed" and "Role" in failed.error_message


def test_header_order_does_not_matter(spark, tmp_path):
    path = write(tmp_path, "partner", ["true,Kim,R1,Owner"], header="Active,Partner_Name,Partner_ID,Role")
    assert rows(read_export(spark, path, ENTITIES["partner"]).select("partner_id", "active")) == [("R1", "true")]


def test_row_numbers_of_files_read_in_many_blocks(spark, tmp_path):
    spec = ENTITIES["partner"]
    paths = [write(tmp_path / f"f{n}", "partner", [f"R{i},name {i},x,true" for i in range(n)]) for n in (3, 700)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        df = read_export(spark, paths, spec, multi_line=False)
        assert df.rdd.getNumPartitions() > 3
        got = df.select("source_file", "partner_id", "source_row_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 703
    assert all(r.source_row_number == int(r.partner_id[1:]) + 2 for r in got)


def test_stream_stages_new_files_once(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    inbox = tmp_path / "inbox"

    def run():
        query = ingest_stream(store, "supplier", str(inbox / "*"), str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
        assert query.exception() is None

    write(inbox / "a", "supplier", ["S1,Mill,,,true", "S1,Mill,,,true", ",No id,,,true"])
    run()
    write(inbox / "b", "supplier", ["S1,Mill,,,true", "S2,Oven,,,false"])
    run()
    run()
    assert rows(store.read("staging", "supplier").select("supplier_id", "record_status")) == [
        (None, "invalid"), ("S1", "pending"), ("S2", "pending"),
    ]
    assert store.read("ops", "ingestion_errors").count() == 1
    assert rows(BatchLedger(store).state().select("batch_id", "records_received", "records_loaded")) == [
        ("supplier-stream-0", 3, 2), ("supplier-stream-1", 2, 1),
    ]



CORRECTIONS = {
    "order": ["O1,2026-11-06,C2,21,0,0,21,20,1,Delivered,Kim,"],
    "order_item": ["I1,O1,P1,3,10,7,0,30,21,L1"],
    "product": ["P1,Nuts,Food,kg,10,8,5,1,true"],
}


@pytest.mark.parametrize("entity", CORRECTIONS)
def test_a_batch_load_equals_a_full_load(loaded, entity):
    """Whatever a corrected row touches, directly or through what depends on it, is loaded with its batch."""
    store, base = loaded
    path = write(base / f"fix-{entity}", entity, CORRECTIONS[entity])
    batch = wj.ingest(store, entity, path)
    wj.stage(store, entity, batch)
    if entity == "product":
        wj.load_dimensions(store, dt.date(2026, 7, 1), dt.date(2026, 12, 31))
    t = wj.StoredTables(store)
    before = {n: rows(t[n]) for n in wj.FACTS}
    wj.load_facts(store, batches=[batch])
    after = {n: rows(t[n]) for n in wj.FACTS}
    assert after != before
    wj.load_facts(store)
    assert {n: rows(t[n]) for n in wj.FACTS} == after


def test_return_lines_follow_the_line_and_the_order_they_return(spark):
    pending = "pending"
    line = "return_item_id string, return_id string, order_item_id string, product_id string, ingestion_batch_id string, record_status string"
    tables = {
        "stg_return_item": spark.createDataFrame(
            [("a", "r1", "i1", "p", "b1", pending), ("b", "r2", "i2", "p", "b1", pending), ("c", "r3", None, "q", "b1", pending)], line
        ),
        "stg_order_item": spark.createDataFrame([("i1", "o1", "b2"), ("i2", "o2", "b1")], "order_item_id string, order_id string, ingestion_batch_id string"),
        "stg_order": spark.createDataFrame([("o2", "b3"), ("o1", "b1")], "order_id string, ingestion_batch_id string"),
        "stg_return": spark.createDataFrame([("r3", "b4")], "return_id string, ingestion_batch_id string"),
        "stg_product": spark.createDataFrame([("q", "b5")], "product_id string, ingestion_batch_id string"),
    }
    chosen = {b: [r[0] for r in rows(wj._of_batches(tables, "fact_return_items", [b])["stg_return_item"])] for b in ("b1", "b2", "b3", "b4", "b5", "b6")}
    assert chosen == {"b1": ["a", "b", "c"], "b2": ["a"], "b3": ["b"], "b4": ["c"], "b5": ["c"], "b6": []}


def test_a_failing_micro_batch_is_recorded(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    write(tmp_path / "inbox", "supplier", ["S1,Mill,true"], header="Supplier_ID,Supplier_Name,Active")
    query = ingest_stream(store, "supplier", str(tmp_path / "inbox"), str(tmp_path / "checkpoint"))
    with pytest.raises(Exception):
        query.awaitTermination(120)
    state = BatchLedger(store).state().first()
    assert (state.batch_id, state.status) == ("supplier-stream-0", "failed") and state.error_message


def test_row_hash_tells_separators_from_text(spark):
    df = spark.createDataFrame([("a|product=b", "c"), ("a", "b|product=c"), ("a\\", "|"), ("a", "\\|")], "flag string, product string")
    assert df.select(row_hash(["flag", "product"]).alias("h")).distinct().count() == 4


def test_line_breaks_inside_quotes_are_looked_for(spark, tmp_path):
    plain = write(tmp_path / "a", "partner", ["R1,\"Kim, \"\"K\"\"\",x,true", "R2,Lee,x,true"])
    broken = write(tmp_path / "b", "partner", ["R1,\"Kim\nLee\",x,true", "R2,Lee,x,true"])
    assert not has_quoted_line_breaks(spark, plain) and has_quoted_line_breaks(spark, [plain, broken])
    assert [r.partner_name for r in read_export(spark, broken, ENTITIES["partner"]).orderBy("partner_id").collect()] == ["Kim\nLee", "Lee"]
