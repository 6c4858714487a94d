"""The driver contract; a few queries run against their SQL here, all of them by check_queries.py."""

import re

import duckdb
import pytest

import __spark_entry__ as contract
from check_queries import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "flagship_top_months", "latest_row_dedupe", "fact_orders_load", "dim_location_upsert", "metric_cash_in", "filter_not_in",
    "preset_last_month", "merge_null_vs_missing", "parse_date_a", "parse_amount", "validate_payment", "quarantine", "dq_orphans",
    "resolve_entities", "failure_counts", "hash_dedupe",
)


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return connection


def test_names():
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
    assert set(n for n in queries if n == "pipeline" or re.match(r"op\d", n)) == set(contract.QUERIES)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["product_category", "period", "gross_sales"] and df.count() == 5


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = contract.queries()[name](spark, FOLDER)
    cursor = con.execute(contract.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())
