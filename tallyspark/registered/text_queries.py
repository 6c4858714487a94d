"""Cleaning, parsing, hashing, validation and quarantine over text made from the tables.

The text is built by one SQL expression that both engines run; the expected
values come from the typed columns the text was made of.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tallyspark.functions import cleaning as cl
from tallyspark.operators.latest import latest_per_key
from tallyspark.plans.replay import CORRECTION, ROW, payload_cells, replayed
from tallyspark.registered.base import doubles, register, table
from tallyspark.sources.csv_source import drop_known_rows, row_hash
from tallyspark.sources.known_rows import filters_of, known_rows_by_filter
from tallyspark.sources.specs import ENTITIES
from tallyspark.sources.staging import insert_new_staged, newest_batch, not_yet_staged, quarantine_rows, raw_rows, type_and_check

_D = "CAST(o_orderdate AS DATE)"
_YEAR, _MONTH, _DAY = (f"CAST({p}({_D}) AS STRING)" for p in ("year", "month", "day"))
_ISO = f"CAST({_D} AS STRING)"
_MONTH_NAME = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month({d}) AS INT) * 3 - 2, 3)"
_SCRIPT = (
    f"'Sat ' || {_MONTH_NAME.format(d=_D)} || ' ' || {_DAY} || ' ' || {_YEAR} || ' 00:00:00 GMT+0600 (Some Standard Time)'"
)
_KIND = "o_orderkey % 7"

_DATE_A = f"""CASE {_KIND} WHEN 0 THEN {_ISO} WHEN 1 THEN {_ISO} || ' 10:11:12' WHEN 2 THEN {_DAY} || '/' || {_MONTH} || '/' || {_YEAR}
WHEN 3 THEN {_MONTH} || '/' || {_DAY} || '/' || {_YEAR} WHEN 4 THEN {_SCRIPT} WHEN 5 THEN 'junk ' || {_DAY} ELSE '   ' END"""
_SWAPPED = f"CASE WHEN day({_D}) <= 12 THEN make_date(year({_D}), day({_D}), month({_D})) ELSE {_D} END"
_DATE_B = f"""CASE {_KIND} WHEN 0 THEN ' ' || {_ISO} || ' ' WHEN 1 THEN {_YEAR} || '/' || {_MONTH} || '/' || {_DAY}
WHEN 2 THEN {_DAY} || '/' || {_MONTH} || '/' || {_YEAR} WHEN 3 THEN {_MONTH} || '/' || {_DAY} || '/' || {_YEAR} WHEN 4 THEN {_SCRIPT}
WHEN 5 THEN '2024-13-45' ELSE {_DAY} || '-' || {_MONTH} || '-' || {_YEAR} END"""


def _orders_text(expression: str, parse):
    def build(spark, folder):
        rows = table("orders")(spark, folder).selectExpr("o_orderkey", f"{expression} AS cell")
        parsed = rows.withColumn("day", parse("cell"))
        return parsed.select("o_orderkey", "day", cl.unreadable("cell", F.col("day")).alias("unreadable"))

    return build


register(
    "parse_date_a",
    _orders_text(_DATE_A, cl.parse_date_day_first),
    f"""SELECT o_orderkey, CASE WHEN {_KIND} = 3 THEN {_SWAPPED} WHEN {_KIND} < 5 THEN {_D} END AS day, {_KIND} = 5 AS unreadable
FROM orders""",
)
register(
    "parse_date_b",
    _orders_text(_DATE_B, cl.parse_date_month_first),
    f"""SELECT o_orderkey, CASE WHEN {_KIND} = 2 THEN {_SWAPPED} WHEN {_KIND} <> 5 THEN {_D} END AS day, {_KIND} = 5 AS unreadable
FROM orders""",
)
register(
    "parse_js_date",
    _orders_text(_SCRIPT, cl.parse_date_day_first),
    f"SELECT o_orderkey, {_D} AS day, FALSE AS unreadable FROM orders",
)
register(
    "strip_zone_name",
    lambda spark, folder: table("orders")(spark, folder)
    .selectExpr("o_orderkey", f"{_SCRIPT} AS cell")
    .select("o_orderkey", cl.drop_zone_name("cell").alias("text")),
    f"SELECT o_orderkey, split_part({_SCRIPT}, ' (', 1) AS text FROM orders",
)

_SECOND = "CAST(date_trunc('second', ts) AS STRING)"
_TS_DAY = "CAST(ts AS DATE)"
_TS_SCRIPT = (
    f"'Mon ' || {_MONTH_NAME.format(d=_TS_DAY)} || ' ' || CAST(day({_TS_DAY}) AS STRING) || ' ' || CAST(year({_TS_DAY}) AS STRING)"
    f" || ' ' || substr({_SECOND}, 12, 8) || ' GMT+0600 (Some Standard Time)'"
)
_TS_MDY = f"CAST(month({_TS_DAY}) AS STRING) || '/' || CAST(day({_TS_DAY}) AS STRING) || '/' || CAST(year({_TS_DAY}) AS STRING)"
_TS_A = f"""CASE event_id % 6 WHEN 0 THEN {_SECOND} WHEN 1 THEN replace({_SECOND}, ' ', 'T') WHEN 2 THEN replace({_SECOND}, ' ', 'T') || '.5'
WHEN 3 THEN {_TS_SCRIPT} WHEN 4 THEN substr({_SECOND}, 1, 10) ELSE '' END"""
_TS_B = f"""CASE event_id % 9 WHEN 0 THEN {_SECOND} WHEN 1 THEN replace({_SECOND}, ' ', 'T') WHEN 2 THEN replace({_SECOND}, ' ', 'T') || '.5'
WHEN 3 THEN {_TS_SCRIPT} WHEN 4 THEN substr({_SECOND}, 1, 10) WHEN 5 THEN substr({_SECOND}, 1, 16)
WHEN 6 THEN {_TS_MDY} || ' ' || substr({_SECOND}, 12, 8) WHEN 7 THEN {_TS_MDY} ELSE 'soon' END"""


def _events_instant(expression: str, parse):
    def build(spark, folder):
        rows = table("events")(spark, folder).selectExpr("event_id", f"{expression} AS cell")
        parsed = rows.withColumn("value", parse("cell"))
        return parsed.select(
            "event_id", F.unix_micros("value").alias("micros"), cl.unreadable("cell", F.col("value")).alias("unreadable")
        )

    return build


_EPOCH = "epoch_us(date_trunc('second', ts))"
register(
    "parse_timestamp_a",
    _events_instant(_TS_A, cl.parse_timestamp_basic),
    f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN {_EPOCH} WHEN 1 THEN {_EPOCH} WHEN 2 THEN {_EPOCH} + 500000
  WHEN 3 THEN {_EPOCH} - 6 * 3600 * CAST(1000000 AS BIGINT) END AS micros, event_id % 6 = 4 AS unreadable FROM events""",
)
register(
    "parse_timestamp_b",
    _events_instant(_TS_B, cl.parse_timestamp_wide),
    f"""SELECT event_id, CASE event_id % 9 WHEN 0 THEN {_EPOCH} WHEN 1 THEN {_EPOCH} WHEN 2 THEN {_EPOCH} + 500000
  WHEN 3 THEN {_EPOCH} - 6 * 3600 * CAST(1000000 AS BIGINT) WHEN 4 THEN epoch_us(date_trunc('day', ts)) WHEN 5 THEN epoch_us(date_trunc('minute', ts))
  WHEN 6 THEN {_EPOCH} WHEN 7 THEN epoch_us(date_trunc('day', ts)) END AS micros, event_id % 9 = 8 AS unreadable FROM events""",
)

# text and numbers -------------------------------------------------------------------

_PAD = "CASE p_partkey % 4 WHEN 0 THEN '  ' || p_name || ' ' WHEN 1 THEN p_name WHEN 2 THEN '' ELSE '   ' END"
register(
    "clean_text",
    lambda spark, folder: table("part")(spark, folder)
    .selectExpr("p_partkey", f"{_PAD} AS cell")
    .select("p_partkey", cl.clean_text("cell").alias("text")),
    "SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN p_name END AS text FROM part",
)
register(
    "normalize_term",
    lambda spark, folder: table("part")(spark, folder)
    .selectExpr("p_partkey", "'  ' || upper(replace(p_name, ' ', '__ ')) || '_' || p_brand || ' ' AS cell")
    .select("p_partkey", cl.normalize_term("cell").alias("term")),
    "SELECT p_partkey, lower(p_name || ' ' || p_brand) AS term FROM part",
)
register(
    "fallback_id",
    lambda spark, folder: table("orders")(spark, folder)
    .selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'C' || CAST(o_orderkey AS STRING) END AS first",
                "'T' || CAST(o_custkey AS STRING) AS second")
    .select("o_orderkey", F.coalesce(cl.clean_text("first"), cl.clean_text("second")).alias("entry_id")),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'T' || CAST(o_custkey AS STRING) ELSE 'C' || CAST(o_orderkey AS STRING) END"
    " AS entry_id FROM orders",
)

_P = "CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS STRING)"
_V = "CAST(o_totalprice AS DECIMAL(14,2))"
_GROUPED = "CAST(o_custkey % 900 + 100 AS STRING) || ',250.75'"
_GROUPED_V = "CAST((o_custkey % 900 + 100) * 1000 + 250.75 AS DECIMAL(14,2))"
_NUMBER = f"""CASE o_orderkey % 10 WHEN 0 THEN {_P} WHEN 1 THEN ' -' || {_P} WHEN 2 THEN {_GROUPED} WHEN 3 THEN '$' || {_GROUPED}
WHEN 4 THEN '(' || {_P} || ')' WHEN 5 THEN '(' || '$' || {_P} || ')' WHEN 6 THEN '1e3' WHEN 7 THEN 'abc' WHEN 8 THEN '' ELSE {_P} || '5' END"""
_PLAIN_CASES = f"WHEN 0 THEN {_V} WHEN 1 THEN -{_V} WHEN 6 THEN 1000 WHEN 9 THEN {_V} + CAST('0.01' AS DECIMAL(3,2))"


def _number(parse):
    def build(spark, folder):
        rows = table("orders")(spark, folder).selectExpr("o_orderkey", f"{_NUMBER} AS cell")
        parsed = rows.withColumn("value", parse("cell"))
        return parsed.select("o_orderkey", "value", cl.unreadable("cell", F.col("value")).alias("unreadable"))

    return build


def _number_sql(cases: str, unreadable: str) -> str:
    return (
        f"SELECT o_orderkey, CAST(CASE o_orderkey % 10 {cases} END AS DOUBLE) AS value, o_orderkey % 10 IN ({unreadable}) AS unreadable"
        " FROM orders"
    )


register("parse_decimal", _number(cl.parse_decimal), _number_sql(_PLAIN_CASES, "2, 3, 4, 5, 7"))
register(
    "parse_decimal_commas", _number(cl.parse_decimal_commas),
    _number_sql(f"{_PLAIN_CASES} WHEN 2 THEN {_GROUPED_V}", "3, 4, 5, 7"),
)
register(
    "parse_decimal_dollars", _number(cl.parse_decimal_dollars),
    _number_sql(f"{_PLAIN_CASES} WHEN 2 THEN {_GROUPED_V} WHEN 3 THEN {_GROUPED_V}", "4, 5, 7"),
)
register(
    "parse_amount", _number(cl.parse_amount),
    _number_sql(f"{_PLAIN_CASES} WHEN 2 THEN {_GROUPED_V} WHEN 3 THEN {_GROUPED_V} WHEN 4 THEN -{_V} WHEN 5 THEN -{_V}", "7"),
)
register(
    "parse_quantity", _number(cl.parse_quantity),
    _number_sql(
        f"{_PLAIN_CASES.replace('0.01', '0.005').replace('DECIMAL(3,2)', 'DECIMAL(4,3)')} WHEN 2 THEN {_GROUPED_V}"
        f" WHEN 4 THEN -{_V}", "3, 5, 7"),
)
register(
    "parse_int",
    lambda spark, folder: table("part")(spark, folder)
    .selectExpr("p_partkey", "CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN ' -' || CAST(p_size AS STRING)"
                " WHEN 2 THEN CAST(p_size AS STRING) || '.5' ELSE '' END AS cell")
    .select("p_partkey", cl.parse_int("cell").alias("value")),
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN -p_size END AS value FROM part",
)
_WORDS = ("Yes", " TRUE ", "1", "active", "y", "N", "0", "Inactive", "no", "false", "", "maybe")
register(
    "parse_bool",
    lambda spark, folder: table("part")(spark, folder)
    .selectExpr("p_partkey", "CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WORDS)) + " END AS cell")
    .select("p_partkey", cl.parse_boolean("cell").alias("flag"), cl.unreadable("cell", cl.parse_boolean("cell")).alias("unreadable")),
    "SELECT p_partkey, CASE WHEN p_partkey % 12 < 5 THEN TRUE WHEN p_partkey % 12 < 10 THEN FALSE END AS flag,"
    " p_partkey % 12 = 11 AS unreadable FROM part",
)

# hashes and known rows -----------------------------------------------------------------

_HASHED = "CAST(l_partkey % 50 AS STRING) AS product, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS flag"
register(
    "row_hash",
    lambda spark, folder: table("lineitem")(spark, folder)
    .selectExpr("l_orderkey", _HASHED.split(", CASE")[0], "CASE" + _HASHED.split(", CASE")[1])
    .select("l_orderkey", row_hash(["product", "flag"]).alias("hash")),
    "SELECT l_orderkey, sha256('flag=' || coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END, '') || '|product='"
    " || CAST(l_partkey % 50 AS STRING)) AS hash FROM lineitem",
)
_ESCAPED_SQL = r"replace(replace({0}, '\', '\\'), '|', '\|')"
register(
    "row_hash_of_free_text",
    # texts hold separators of their own: the tables of symbol pages are full of them
    lambda spark, folder: table("documents")(spark, folder)
    .select("doc_id", F.concat("text", F.lit("\\|"), "source").alias("note"), F.col("text").alias("body"))
    .select("doc_id", row_hash(["note", "body"]).alias("hash")),
    "SELECT doc_id, sha256('body=' || {} || '|note=' || {}) AS hash FROM documents".format(
        _ESCAPED_SQL.format("text"), _ESCAPED_SQL.format("text || '\\|' || source")
    ),
)


def _hash_dedupe(spark, folder):
    rows = (
        table("lineitem")(spark, folder)
        .selectExpr("l_orderkey", "l_linenumber", "CAST(l_partkey AS STRING) AS product", "l_returnflag AS flag")
        .withColumn("source_row_hash", row_hash(["product", "flag"]))
        .withColumn("source_row_number", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint"))
        .withColumn("source_file", F.lit("lineitem"))
    )
    known = rows.where("l_orderkey % 10 = 0")
    return drop_known_rows(rows, known).select("product", "flag", "source_row_number")


register(
    "hash_dedupe",
    _hash_dedupe,
    """SELECT CAST(l_partkey AS STRING) AS product, l_returnflag AS flag, min(l_orderkey * 10 + l_linenumber) AS source_row_number
FROM lineitem WHERE (l_partkey, l_returnflag) NOT IN (SELECT (l_partkey, l_returnflag) FROM lineitem WHERE l_orderkey % 10 = 0)
GROUP BY l_partkey, l_returnflag""",
)


def _known_by_filter(spark, folder):
    """Lines whose product and flag are in one of ten batches, found by the filters of the batches."""
    rows = (
        table("lineitem")(spark, folder)
        .selectExpr("l_orderkey", "CAST(l_partkey AS STRING) AS product", "l_returnflag AS flag", "CONCAT('b', l_orderkey % 10) AS ingestion_batch_id")
        .withColumn("source_row_hash", row_hash(["product", "flag"]))
    )
    raw, load = rows.where("l_orderkey % 3 = 0"), rows.where("l_orderkey % 3 = 1")
    known = known_rows_by_filter(load, raw, filters_of(raw))
    return load.join(known, "source_row_hash", "left_semi").groupBy("product", "flag").agg(F.count("*").alias("lines"))


register(
    "known_rows_by_filter",
    _known_by_filter,
    """SELECT CAST(l_partkey AS STRING) AS product, l_returnflag AS flag, count(*) AS lines FROM lineitem
WHERE l_orderkey % 3 = 1 AND (l_partkey, l_returnflag) IN (SELECT (l_partkey, l_returnflag) FROM lineitem WHERE l_orderkey % 3 = 0)
GROUP BY l_partkey, l_returnflag""",
)
register(
    "newest_batch",
    lambda spark, folder: newest_batch(
        table("events")(spark, folder).select(
            F.concat(F.lit("batch "), F.col("event_id").cast("string")).alias("ingestion_batch_id"), F.col("ts").alias("ingested_at")
        )
    ),
    "SELECT 'batch ' || CAST(max_by(event_id, ts) AS STRING) AS ingestion_batch_id FROM events",
)
register(
    "raw_scan_of_batch",
    lambda spark, folder: raw_rows(
        table("events")(spark, folder).select("event_id", F.col("event_type").alias("ingestion_batch_id")), "click"
    ),
    "SELECT event_id, event_type AS ingestion_batch_id FROM events WHERE event_type = 'click'",
)
register(
    "raw_scan_not_staged",
    lambda spark, folder: not_yet_staged(
        table("customer")(spark, folder).select(F.col("c_custkey").alias("raw_id"), "c_name"),
        table("orders")(spark, folder).where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("source_row_identifier")),
    ),
    "SELECT c_custkey AS raw_id, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0)",
)
register(
    "staging_insert_ignore",
    lambda spark, folder: insert_new_staged(
        table("lineitem")(spark, folder).select(
            F.col("l_returnflag").alias("ingestion_batch_id"), F.col("l_linestatus").alias("source_table"),
            F.col("l_orderkey").alias("source_row_identifier"),
        ),
        table("lineitem")(spark, folder).where("l_linenumber = 1").select(
            F.col("l_returnflag").alias("ingestion_batch_id"), F.col("l_linestatus").alias("source_table"),
            F.col("l_orderkey").alias("source_row_identifier"),
        ),
    ),
    """SELECT DISTINCT l_returnflag AS ingestion_batch_id, l_linestatus AS source_table, l_orderkey AS source_row_identifier
FROM lineitem WHERE (l_returnflag, l_linestatus, l_orderkey) NOT IN
  (SELECT (l_returnflag, l_linestatus, l_orderkey) FROM lineitem WHERE l_linenumber = 1)""",
)
register(
    "dedupe_first_by_number",
    lambda spark, folder: latest_per_key(
        table("conversations")(spark, folder).select("conv_id", "turn", "role"), ["conv_id"], ["turn", "role"]
    ),
    "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER"
    " (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC NULLS LAST) = 1",
)

# row validation ---------------------------------------------------------------------------

# what a row of each base table has to tell: a text, a number and a day (Spark and DuckDB read these alike)
_REAL = {
    "customer": ("c_name", "CAST(c_acctbal AS DECIMAL(14,2))", "DATE '1995-01-01' + CAST(c_custkey % 3000 AS INT)"),
    "part": ("p_name", "CAST(p_retailprice AS DECIMAL(14,2))", "DATE '1995-01-01' + CAST(p_size * 40 AS INT)"),
    "orders": ("o_orderpriority", "CAST(o_totalprice AS DECIMAL(14,2))", "CAST(o_orderdate AS DATE)"),
    "events": ("event_type", "CAST(CAST(value AS DECIMAL(14,2)) + 1 AS DECIMAL(14,2))", "CAST(ts AS DATE)"),
}
_THOUSANDS = "CAST(k % 900 + 100 AS STRING) || ',' || lpad(CAST(k % 1000 AS STRING), 3, '0')"
# a cell that passes, by parser, and the value it stands for
_GOOD = {
    "text": ("txt || ' ' || CAST(k AS STRING)", "txt || ' ' || CAST(k AS STRING)"),
    **{p: ("CAST(day AS STRING)", "day") for p in ("date_day_first", "date_month_first")},
    **{p: ("CAST(day AS STRING) || ' 10:20:30'", "CAST(day AS TIMESTAMP)") for p in ("timestamp_basic", "timestamp_wide")},
    "int": ("CAST(k % 1000 AS STRING)", "k % 1000"),
    "money": ("CAST(num AS STRING)", "num"),
    "quantity": ("CAST(k % 90 + 1 AS STRING) || '.125'", "k % 90 + 1.125"),
    "money_commas": (f"{_THOUSANDS} || '.50'", "(k % 900 + 100) * 1000 + k % 1000 + 0.5"),
    "quantity_commas": (f"{_THOUSANDS} || '.125'", "(k % 900 + 100) * 1000 + k % 1000 + 0.125"),
    "money_dollars": (f"'$' || {_THOUSANDS} || '.50'", "(k % 900 + 100) * 1000 + k % 1000 + 0.5"),
    "amount": ("CASE WHEN k % 2 = 1 THEN '(' || CAST(num AS STRING) || ')' ELSE CAST(num AS STRING) END", "CASE WHEN k % 2 = 1 THEN -num ELSE num END"),
    "quantity_signed": ("'(' || CAST(k % 90 + 1 AS STRING) || '.5)'", "-(k % 90 + 1.5)"),
    "boolean": ("CASE k % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN ' false' ELSE '1' END", "k % 3 <> 1"),
}
BASE = {
    "customer": ("customer", "c_custkey"), "product": ("part", "p_partkey"), "partner": ("customer", "c_custkey"),
    "supplier": ("part", "p_partkey"), "stock_location": ("customer", "c_custkey"), "cash_account": ("part", "p_partkey"),
    "order": ("orders", "o_orderkey"), "order_item": ("orders", "o_orderkey"), "payment": ("events", "event_id"),
    "purchase": ("orders", "o_orderkey"), "purchase_item": ("orders", "o_orderkey"), "return": ("orders", "o_orderkey"),
    "return_item": ("orders", "o_orderkey"), "stock_movement": ("events", "event_id"), "cash_transaction": ("events", "event_id"),
    "expense": ("events", "event_id"), "partner_capital": ("events", "event_id"),
}
_T, _V_ = "transform_error", "validation_error"


def _req(*names: str) -> str:
    return "; ".join(f"{n} is required." for n in names)


def _neg(*names: str) -> str:
    return "; ".join(f"{n} cannot be negative." for n in names)


def _unread(name: str, kind: str) -> str:
    return f"{name} could not be read as {kind}."


_MONEY, _QTY = "decimal(14,2)", "decimal(14,3)"
# entity -> broken rows: (raw cells replaced, messages, kind of error)
BREAKS: dict[str, list[tuple[dict[str, str], str, str]]] = {
    "customer": [
        ({"customer_id": "NULL", "customer_name": "'  '"}, _req("customer_id", "customer_name"), _V_),
        ({"first_order_date": "'2024-05-01'", "last_order_date": "'30/04/2024'"},
         "first_order_date cannot be later than last_order_date.", _V_),
        ({"total_orders": "'-1'", "total_due": "'-0.01'"}, _neg("total_orders", "total_due"), _V_),
        ({"total_orders": "'1.5'"}, _unread("total_orders", "int"), _T),
        ({"last_order_date": "'soon'", "customer_name": "NULL"},
         f"{_unread('last_order_date', 'date')}; {_req('customer_name')}", _T),
    ],
    "product": [
        ({"product_id": "' '"}, _req("product_id"), _V_),
        ({"selling_price": "'-1'", "reorder_level": "'-2'"}, _neg("selling_price", "reorder_level"), _V_),
        ({"active": "'maybe'"}, _unread("active", "boolean"), _T),
        ({"cost_price": "'1,000'"}, _unread("cost_price", _MONEY), _T),
    ],
    "partner": [
        ({"partner_name": "NULL"}, _req("partner_name"), _V_), ({"active": "'2'"}, _unread("active", "boolean"), _T),
        ({"partner_id": "''", "partner_name": "''"}, _req("partner_id", "partner_name"), _V_),
    ],
    "supplier": [
        ({"supplier_id": "NULL"}, _req("supplier_id"), _V_), ({"active": "'on'"}, _unread("active", "boolean"), _T),
    ],
    "stock_location": [
        ({"location_name": "''"}, _req("location_name"), _V_), ({"active": "'off'"}, _unread("active", "boolean"), _T),
    ],
    "cash_account": [
        ({"account_name": "''"}, _req("account_name"), _V_), ({"total_in": "'-5'"}, _neg("total_in"), _V_),
        ({"current_balance": "'-5'"}, "", ""), ({"total_out": "'$5'"}, _unread("total_out", _MONEY), _T),
    ],
    "order": [
        ({"order_date": "''", "order_id": "NULL"}, _req("order_id", "order_date"), _V_),
        ({"order_date": "'2024/01/01'"}, f"{_unread('order_date', 'date')}; {_req('order_date')}", _T),
        ({"due": "'-1'", "subtotal": "'-1'"}, _neg("subtotal", "due_amount"), _V_),
        ({"created_at": "'2024-03-05'"}, _unread("source_created_at", "timestamp"), _T),
    ],
    "order_item": [
        ({"order_id": "NULL", "quantity": "NULL"}, _req("order_id", "quantity"), _V_),
        ({"cogs": "'-1'", "discount": "'-2'"}, _neg("item_discount", "cogs"), _V_),
        ({"unit_price": "'free'"}, _unread("unit_price", _MONEY), _T),
    ],
    "payment": [
        ({"amount": "'0'"}, "amount must be greater than zero.", _V_), ({"amount": "''"}, _req("amount"), _V_),
        ({"payment_date": "'x'", "amount": "'-3'"},
         f"{_unread('payment_date', 'date')}; {_req('payment_date')}; amount must be greater than zero.", _T),
    ],
    "purchase": [
        ({"purchase_id": "NULL"}, _req("purchase_id"), _V_),
        ({"purchase_date": "'99/99/2024'"}, f"{_unread('purchase_date', 'date')}; {_req('purchase_date')}", _V_),
        ({"paid": "'ten'", "created_at": "'noon'"},
         f"{_unread('paid_amount', _MONEY)}; {_unread('source_created_at', 'timestamp')}", _V_),
    ],
    "purchase_item": [
        ({"product_id": "NULL"}, _req("product_id"), _V_), ({"unit_cost": "'$1'"}, _unread("unit_cost", _MONEY), _T),
        ({"quantity": "''"}, _req("quantity"), _V_),
    ],
    "return": [
        ({"return_id": "''"}, _req("return_id"), _V_), ({"refund_amount": "'-1'"}, _neg("refund_amount"), _V_),
        ({"return_date": "'1-2-2024'"}, f"{_unread('return_date', 'date')}; {_req('return_date')}", _T),
    ],
    "return_item": [
        ({"quantity": "'0'"}, "quantity must be greater than zero.", _V_), ({"line_amount": "'-4'"}, _neg("amount"), _V_),
        ({"return_id": "NULL", "unit_price": "'-1'"}, f"{_req('return_id')}; {_neg('unit_price')}", _V_),
    ],
    "stock_movement": [
        ({"movement_type": "''"}, _req("movement_type"), _V_), ({"quantity": "'few'"}, f"{_unread('quantity', _QTY)}; {_req('quantity')}", _T),
        ({"created_at": "'never'"}, _unread("source_created_at", "timestamp"), _V_),
    ],
    "cash_transaction": [
        ({"transaction_date": "'bad'"}, f"{_unread('transaction_date', 'date')}; {_req('transaction_date')}", _V_),
        ({"amount": "'(5)'"}, f"{_unread('amount', _MONEY)}; {_req('amount')}", _T),
        ({"cash_transaction_id": "NULL", "transaction_type": "NULL"}, _req("transaction_id", "transaction_type"), _V_),
    ],
    "expense": [
        ({"expense_id": "NULL", "amount": "NULL"}, _req("expense_id", "amount"), _V_),
        ({"amount": "'(abc)'"}, f"{_unread('amount', _MONEY)}; {_req('amount')}", _T),
    ],
    "partner_capital": [
        ({"partner_id": "''"}, _req("partner_id"), _V_), ({"capital_transaction_id": "''"}, _req("partner_capital_entry_id"), _V_),
        ({"transaction_date": "'31-31-2024'"}, f"{_unread('entry_date', 'date')}; {_req('entry_date')}", _V_),
    ],
}
MODULUS = 11


def _base_rows(entity: str) -> tuple[str, str, str, str, str]:
    """Base table, and its key, text, number and day. Rows that are broken on purpose have no negative number of their own."""
    base, key = BASE[entity]
    text, number, day = _REAL[base]
    planned = f"({key}) % {MODULUS} < {len(BREAKS[entity])}"
    return base, key, text, f"CASE WHEN {planned} THEN abs({number}) ELSE {number} END", day


def _cells(entity: str, broken: bool = True) -> dict[str, str]:
    """Raw column -> the text of its cells, for both engines, with or without the broken ones."""
    spec = ENTITIES[entity]
    parser_of = {f.source: f.parser for f in spec.staged if isinstance(f.source, str)}
    cells = {}
    for c in spec.raw_columns:
        good = _GOOD[parser_of.get(c, "text")][0]
        cases = " ".join(f"WHEN {i} THEN {b[0][c]}" for i, b in enumerate(BREAKS[entity]) if broken and c in b[0])
        cells[c] = f"CAST({f'CASE k % {MODULUS} {cases} ELSE {good} END' if cases else good} AS STRING)"
    return cells


def _raw_entity(entity: str):
    """Raw text rows of an entity: one per row of its base table, some of them broken."""
    spec = ENTITIES[entity]
    base, key, text, number, day = _base_rows(entity)
    cells = [f"{e} AS {c}" for c, e in _cells(entity).items()]

    def build(spark, folder):
        rows = table(base)(spark, folder).selectExpr(f"{key} AS k", f"{text} AS txt", f"{number} AS num", f"{day} AS day").selectExpr("k", *cells)
        return rows.select(
            *spec.raw_columns,
            F.col("k").cast("string").alias("raw_id"),
            F.col("k").alias("source_row_number"),
            F.lit("batch-1").alias("ingestion_batch_id"),
            F.lit("2024-04-01 00:00:00").cast("timestamp").alias("ingested_at"),
            row_hash(spec.raw_columns).alias("source_row_hash"),
        )

    return build


def _case(values: list[str], otherwise: str = "NULL") -> str:
    cases = " ".join(f"WHEN {i} THEN {f"'{v}'" if v else 'NULL'}" for i, v in enumerate(values))
    return f"CASE k % {MODULUS} {cases} ELSE {otherwise} END"


#: Balances below zero break rules by themselves.
_NATURAL = {"customer": f"CASE WHEN num < 0 THEN '{_neg('total_spent', 'total_paid', 'total_due')}' END"}
_SHOWN = {"text_value": ("text",), "day_value": ("date_day_first", "date_month_first"),
          "number_value": ("money", "money_commas", "money_dollars", "amount", "quantity_signed", "quantity", "quantity_commas")}


def _shown(entity: str) -> dict[str, tuple[str, str]]:
    """Column of the query -> (staged column, parser): the first of each kind that the entity has."""
    out = {}
    for name, parsers in _SHOWN.items():
        own = [f for f in ENTITIES[entity].staged if f.parser in parsers and isinstance(f.source, str)]
        if own:
            out[name] = (own[0].name, own[0].parser)
    return out


def _checked(spark, folder, entity: str):
    rows = type_and_check(_raw_entity(entity)(spark, folder), ENTITIES[entity])
    planned = F.col("source_row_number") % MODULUS < len(BREAKS[entity])
    values = [
        F.when(~planned, F.col(c)).cast("double" if name == "number_value" else rows.schema[c].dataType).alias(name)
        for name, (c, _) in _shown(entity).items()
    ]
    return rows.select(F.col("source_row_number").alias("k"), "record_status", "error_type", "validation_error", *values)


def _checked_sql(entity: str) -> str:
    base, key, text, number, day = _base_rows(entity)
    natural = _NATURAL.get(entity, "NULL")
    breaks = BREAKS[entity]
    values = "".join(
        f", CASE WHEN k % {MODULUS} >= {len(breaks)} THEN {f'CAST({_GOOD[p][1]} AS DOUBLE)' if name == 'number_value' else _GOOD[p][1]} END AS {name}"
        for name, (_, p) in _shown(entity).items()
    )
    return f"""SELECT k, CASE WHEN validation_error IS NULL THEN 'pending' ELSE 'invalid' END AS record_status, error_type, validation_error
  {"".join(f", {n}" for n in _shown(entity))}
FROM (SELECT k, {_case([b[1] for b in breaks], natural)} AS validation_error,
  {_case([b[2] for b in breaks], f"CASE WHEN {natural} IS NOT NULL THEN '{_V_}' END")} AS error_type{values}
  FROM (SELECT {key} AS k, {text} AS txt, {number} AS num, {day} AS day FROM {base}))"""


for _entity in BREAKS:
    register(f"validate_{_entity}", lambda spark, folder, e=_entity: _checked(spark, folder, e), _checked_sql(_entity))


def _quarantined(spark, folder):
    parts = [
        quarantine_rows(type_and_check(_raw_entity(e)(spark, folder), ENTITIES[e])) for e in ("order", "payment", "customer")
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("source_table", "error_type", "error_message").agg(
        F.count("*").alias("rejected"), F.count_if(F.col("raw_payload").startswith("{")).alias("with_payload")
    )


def _quarantine_sql(entity: str) -> str:
    return (
        f"SELECT '{ENTITIES[entity].table}' AS source_table, error_type, validation_error AS error_message, count(*) AS rejected,"
        f" count(*) AS with_payload FROM ({_checked_sql(entity)}) WHERE record_status = 'invalid' GROUP BY error_type, validation_error"
    )


register("quarantine", _quarantined, " UNION ALL ".join(map(_quarantine_sql, ("order", "payment", "customer"))))

_HASH = "CAST(conv(substr(md5(concat(k, '|', cell.value)), 1, 8), 16, 10) AS BIGINT)"


def _payload_cells(spark, folder):
    """Per entity and raw column, the cells read back from the payloads of its rejected rows."""
    parts = []
    for entity, spec in ENTITIES.items():
        rejected = type_and_check(_raw_entity(entity)(spark, folder), spec).where("record_status = 'invalid'")
        cells = payload_cells(rejected.select("source_table", F.col(ROW).alias("k"), "raw_payload"), spec)
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in spec.raw_columns]))
        parts.append(cells.select("source_table", "k", each.alias("cell")))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.groupBy("source_table", F.col("cell.field").alias("field")).agg(
        F.count("*").alias("rejected"), F.count("cell.value").alias("cells"), F.coalesce(F.sum(F.expr(_HASH)), F.lit(0)).alias("cells_hash")
    )


def _source_cells_sql(entity: str) -> str:
    base, key, text, number, day = _base_rows(entity)
    each = ", ".join(f"{{'field': '{c}', 'value': nullif(trim({e}), '')}}" for c, e in _cells(entity).items())
    return f"""SELECT '{ENTITIES[entity].table}' AS source_table, k, unnest([{each}]) AS cell
FROM (SELECT {key} AS k, {text} AS txt, {number} AS num, {day} AS day FROM {base})
WHERE k IN (SELECT k FROM ({_checked_sql(entity)}) WHERE record_status = 'invalid')"""


register(
    "payload_cells",
    _payload_cells,
    f"""SELECT source_table, cell.field AS field, count(*) AS rejected, count(cell.value) AS cells,
  CAST(coalesce(sum(CAST('0x' || substr(md5(concat(k, '|', cell.value)), 1, 8) AS BIGINT)) FILTER (cell.value IS NOT NULL), 0) AS BIGINT) AS cells_hash
FROM ({" UNION ALL ".join(map(_source_cells_sql, ENTITIES))}) GROUP BY source_table, cell.field""",
)


def _replayed(spark, folder, entity: str):
    """Rejected rows of an entity after their broken cells were corrected."""
    spec = ENTITIES[entity]
    rejected = type_and_check(_raw_entity(entity)(spark, folder), spec).where("record_status = 'invalid'")
    base, key, text, number, day = _base_rows(entity)
    broken = sorted({c for b in BREAKS[entity] for c in b[0]})
    good = table(base)(spark, folder).selectExpr(f"{key} AS k", f"{text} AS txt", f"{number} AS num", f"{day} AS day").where(
        f"k % {MODULUS} < {len(BREAKS[entity])}"
    ).selectExpr(f"CAST(k AS STRING) AS {ROW}", *[f"{e} AS {c}" for c, e in _cells(entity, broken=False).items() if c in broken])
    rows = replayed(rejected, spec, "replay-1", good.select(ROW, F.to_json(F.struct(*broken)).alias(CORRECTION)))
    values = [
        F.col(c).cast("double" if name == "number_value" else rows.schema[c].dataType).alias(name) for name, (c, _) in _shown(entity).items()
    ]
    return rows.select("source_table", F.col("source_row_number").alias("k"), "ingestion_batch_id", "record_status", *values)


def _replayed_sql(entity: str) -> str:
    base, key, text, number, day = _base_rows(entity)
    shown = _shown(entity)
    kinds = {"text_value": "VARCHAR", "day_value": "DATE", "number_value": "DOUBLE"}
    values = ", ".join(f"CAST({_GOOD[shown[n][1]][1] if n in shown else 'NULL'} AS {t}) AS {n}" for n, t in kinds.items())
    return f"""SELECT '{ENTITIES[entity].table}' AS source_table, k, 'replay-1' AS ingestion_batch_id, 'pending' AS record_status, {values}
FROM (SELECT {key} AS k, {text} AS txt, {number} AS num, {day} AS day FROM {base}) WHERE {_case([b[1] for b in BREAKS[entity]])} IS NOT NULL"""


register(
    "quarantine_replay",
    lambda spark, folder: reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [_replayed(spark, folder, e) for e in ENTITIES]
    ),
    " UNION ALL ".join(map(_replayed_sql, ENTITIES)),
)

_STAGED_NUMBERS = "quantity unit_price item_discount line_amount cogs"


def _staged_values_sql() -> str:
    parser_of = {f.name: f.parser for f in ENTITIES["order_item"].staged}
    base, key, text, number, day = _base_rows("order_item")
    numbers = ", ".join(f"CAST({_GOOD[parser_of[c]][1]} AS DOUBLE) AS {c}" for c in _STAGED_NUMBERS.split())
    name = _GOOD["text"][1]
    return f"""SELECT {name} AS order_item_id, {name} AS stock_location_id, {numbers}
FROM (SELECT {key} AS k, {text} AS txt, {number} AS num, {day} AS day FROM {base}) WHERE k % {MODULUS} >= {len(BREAKS["order_item"])}"""


register(
    "staged_values",
    # the typed values behind the checks of one entity
    lambda spark, folder: type_and_check(_raw_entity("order_item")(spark, folder), ENTITIES["order_item"])
    .where(F.col("record_status") == "pending")
    .select("order_item_id", "stock_location_id", *_STAGED_NUMBERS.split()),
    _staged_values_sql(),
)
