import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import evalstats as ev
from tallyspark.operators import quality as q
from tallyspark.operators import resolve as rs
from tallyspark.plans.metrics import standard_registry
from tests.conftest import rows

FIELDS = ["check_name", "status", "severity", "affected_rows"]


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame([(1, 1, 10), (2, 9, 20), (2, None, -5)], "id int, customer_id int, amount int")


def one(df):
    return [tuple(r) for r in df.select(*FIELDS[1:]).collect()]


def test_structure_checks(spark, orders):
    assert one(q.table_exists(spark, {"orders": orders}, "orders")) == [("PASS", "INFO", 0)]
    assert one(q.table_exists(spark, None, "no_such_table")) == [("FAIL", "ERROR", 1)]
    assert one(q.columns_exist(orders, "orders", ["id", "email"])) == [("FAIL", "ERROR", 1)]
    assert one(q.column_types(orders, "orders", {"id": "int", "amount": "bigint", "gone": "int"})) == [("FAIL", "ERROR", 2)]
    assert one(q.column_types(orders, "orders", {"id": "int"})) == [("PASS", "INFO", 0)]


def test_key_checks(spark, orders):
    customers = spark.createDataFrame([(1, "a")], "id int, email string")
    assert one(q.duplicate_check(orders, "orders", "id")) == [("FAIL", "ERROR", 1)]
    assert one(q.duplicate_check(orders, "orders", "id", False)) == [("WARNING", "WARNING", 1)]
    assert one(q.duplicate_check(orders, "orders", "amount")) == [("PASS", "INFO", 0)]
    assert one(q.orphan_check(orders, "orders", "customer_id", customers, "customers", "id")) == [("FAIL", "ERROR", 1)]


def test_table_checks_share_one_aggregate(spark, orders):
    checks = [
        q.null_rate("orders", "customer_id", 50.0), q.null_rate("orders", "customer_id", 10.0), q.not_null("orders", "id"),
        q.value_range("orders", "amount", 0, 15),
    ]
    report = q.run_table_checks(orders, checks)
    assert [tuple(r)[1:4] for r in report.collect()] == [
        ("PASS", "INFO", 0), ("WARNING", "WARNING", 1), ("PASS", "INFO", 0), ("WARNING", "WARNING", 2),
    ]
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
    status = q.report_status(report).first()
    assert (status.status, status.total_count, status.warning_count) == ("WARNING", 4, 2)


def test_empty_table_passes_null_rate(orders):
    empty = orders.where("false")
    assert one(q.run_table_checks(empty, [q.null_rate("orders", "id")])) == [("PASS", "INFO", 0)]


def test_freshness(spark):
    now = F.lit("2026-08-20 00:00:00").cast("timestamp")
    df = spark.createDataFrame([(dt.datetime(2026, 8, 19),)], "at timestamp")
    assert one(q.run_table_checks(df, [q.freshness("t", "at", 24, now)])) == [("PASS", "INFO", 0)]
    assert one(q.run_table_checks(df, [q.freshness("t", "at", 23, now)])) == [("WARNING", "WARNING", 1)]
    assert one(q.run_table_checks(df.where("false"), [q.freshness("t", "at", 23, now)])) == [("WARNING", "WARNING", 1)]


def test_line_amounts(spark):
    df = spark.sql("SELECT * FROM VALUES (2.0D, 3.0D, 6.0D, 0D), (2.0D, 3.0D, 5.0D, 1D), (2.0D, 3.0D, NULL, NULL) AS t(n, p, total, off)")
    assert one(q.run_table_checks(df, [q.line_amount("t", "n", "p", "total")])) == [("FAIL", "ERROR", 1)]
    assert one(q.run_table_checks(df, [q.line_amount("t", "n", "p", "total", discount="off")])) == [("PASS", "INFO", 0)]


def test_overall_status(spark):
    def report(*statuses):
        return q.report_status(spark.createDataFrame([("c", s, "INFO", 0, "") for s in statuses], q.REPORT_SCHEMA)).first().status

    assert (report("PASS"), report("PASS", "WARNING"), report("WARNING", "FAIL")) == ("PASS", "WARNING", "FAIL")


# terms and entities ---------------------------------------------------------------------------


def test_metric_terms(spark):
    terms = spark.createDataFrame([("Gross Sales",), ("earn",), ("PROFIT",), ("umbrellas",), (" ",), (None,)], "t string")
    got = rs.resolve_metrics(terms, "t", rs.metric_vocabulary(spark, standard_registry()))
    assert {r.t: (r.status, r.resolved, r.candidates) for r in got.collect()} == {
        "Gross Sales": ("resolved", "gross_sales", None),
        "earn": ("ambiguous", None, ["gross_business_margin", "gross_sales", "net_sales"]),
        "PROFIT": ("resolved", "gross_business_margin", None),
        "umbrellas": ("not_found", None, None), " ": ("invalid", None, None), None: ("invalid", None, None),
    }


def test_entities(spark):
    directory = spark.createDataFrame([("L1", "Harbour"), ("L2", "Harbour North"), ("L3", "Garden"), ("L4", "Garden"), ("L5", "XY")], "id string, name string")
    said = spark.createDataFrame([("harbour",), ("Harbour_North",), ("north",), ("garden",), ("harb",), ("the XY shop",), ("x",), ("none",), ("  ",)], "v string")
    got = {r.v: (r.status, r.resolved, r.match_count) for r in rs.resolve_entities(said, "v", directory).collect()}
    assert got == {
        "harbour": ("resolved", "L1", 1), "Harbour_North": ("resolved", "L2", 1), "north": ("resolved", "L2", 1),
        "garden": ("ambiguous", None, 2), "harb": ("ambiguous", None, 2), "the XY shop": ("resolved", "L5", 1),
        "x": ("resolved", "L5", 1), "none": ("not_found", None, 0), "  ": ("not_found", None, 0),
    }


def test_entity_matches_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))
    names, values = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)})
    directory = spark.createDataFrame([(f"i{i}", n) for i, n in enumerate(names)], "id string, name string")
    got = rs.entity_matches(spark.createDataFrame([(v,) for v in values], "v string"), "v", directory)
    want = sorted((v, f"i{i}", n, v == n) for v in values for i, n in enumerate(names) if v in n or n in v)
    assert rows(got) == want


# evaluation -----------------------------------------------------------------------------------


def test_evaluation_files(spark, tmp_path):
    case = {"id": "a", "question": "q", "category": "direct", "difficulty": "easy", "expected_status": "success",
            "expected": {"metrics": ["gross_sales"], "dimensions": [], "filters": [{"field": "x", "operator": "eq", "value": "1"}], "time_grain": None}}
    wrong = {"id": "a", "question": "q", "category": "direct", "difficulty": "easy", "expected_status": "failure"}
    (tmp_path / "listed.json").write_text(json.dumps([case, wrong], indent=1))
    (tmp_path / "wrapped.json").write_text(json.dumps({"version": "v1", "cases": [case]}, indent=1))
    assert ev.read_cases(spark, str(tmp_path / "wrapped.json")).first().expected.metrics == ["gross_sales"]
    errors = ev.case_errors(ev.read_cases(spark, str(tmp_path / "listed.json")))
    assert sorted(len(r.errors) for r in errors.collect()) == [1, 2]


def test_breakdown_and_failures(spark):
    results = spark.createDataFrame(
        [("1", "direct", "easy", True, "success", None, []), ("2", "direct", "hard", False, "success", None, ["metrics", "filters", "shape"]),
         ("3", "time", "easy", False, "failure", "planning", []), ("4", "time", "easy", False, "failure", "unexpected_error", []),
         ("5", "time", "easy", False, "success", None, [])],
        "case_id string, category string, difficulty string, passed boolean, actual_status string, actual_failed_stage string, field_diffs array<string>",
    )
    got = {(r.breakdown, r.value): (r.total, r.passed, r.failed, r.accuracy) for r in ev.evaluation_breakdown(results).collect()}
    assert got[("overall", None)] == (5, 1, 4, 20.0)
    assert got[("category", "time")] == (3, 0, 3, 0.0) and got[("difficulty", "easy")] == (4, 1, 3, 25.0)
    assert dict(rows(ev.failure_counts(results))) == {
        "metric_mismatch": 1, "filter_mismatch": 1, "unknown_mismatch": 2, "pipeline_failure": 1, "planning_failure": 1, "unexpected_error": 1,
    }
    assert rows(ev.failed_cases(results)) == [("2",), ("3",), ("4",), ("5",)]


def test_more_checks_of_a_table_join_its_scan(spark):
    sales = spark.createDataFrame(
        [(1, "1-1", 1.0), (2, "1-2", None), (None, "1-3", 5000.0)], "sales_key bigint, order_item_id string, line_total double"
    ).select("*", *[F.lit("x").alias(c) for c in q.CORE_NOT_NULL["fact_sales"] if c not in ("sales_key", "order_item_id", "line_total")])
    sales = sales.withColumn("marked", F.length("order_item_id") + 17)
    large = F.when(F.col("line_total") > 1000, F.col("line_total"))
    also = {"fact_sales": [q.not_null("broken", "sales_key"), q.not_null("broken", "line_total", large), q.not_null("broken", "marked")]}
    report = q.warehouse_structure(spark, {"fact_sales": sales}, also=also)
    found = {r.check_name: (r.status, r.affected_rows) for r in report.where("check_name LIKE 'nullability:%'").collect()}
    assert len(found) == len(q.CORE_NOT_NULL["fact_sales"]) + 3
    assert found["nullability:fact_sales.sales_key"] == found["nullability:broken.sales_key"] == ("FAIL", 1)
    assert found["nullability:fact_sales.line_total"] == ("FAIL", 1) and found["nullability:broken.line_total"] == ("FAIL", 2)
    assert found["nullability:broken.marked"] == found["nullability:fact_sales.quantity"] == ("PASS", 0)
    assert report._jdf.queryExecution().analyzed().toString().count("AS marked#") == 1
    only = q.warehouse_structure(spark, {"fact_sales": sales}, verify_nulls=False, also=also).where("check_name LIKE 'nullability:%'")
    assert only.count() == 3
