import pytest
from pyspark.sql import functions as F

from tallyspark.operators.rules import (
    Rule, check_rows, enforce_constraints, not_negative, required, return_reference_rule, split_rows, table_constraints,
)
from tallyspark.plans.facts import FACTS
from tallyspark.sources.specs import ENTITIES
from tests.conftest import rows


def test_all_broken_rules_are_kept_in_order(spark):
    df = spark.createDataFrame([(None, -1), ("a", None), ("b", 3)], "id string, n int")
    checked = check_rows(df, [required("id"), not_negative("n")])
    assert rows(checked.select("id", "record_status", "validation_error")) == [
        (None, "invalid", "id is required.; n cannot be negative."), ("a", "pending", None), ("b", "pending", None),
    ]
    good, bad = split_rows(checked)
    assert (good.count(), bad.count()) == (2, 1)


def test_constraint_modes(spark):
    df = spark.createDataFrame([(1,), (-1,)], "n int")
    kept, broken = enforce_constraints(df, [not_negative("n")])
    assert rows(kept) == [(1,)] and rows(broken.select("n")) == [(-1,)]
    strict, _ = enforce_constraints(df, [not_negative("n")], "fail")
    with pytest.raises(Exception, match="n cannot be negative"):
        strict.collect()
    with pytest.raises(ValueError):
        enforce_constraints(df, [], "ignore")


def test_return_reference(spark):
    df = spark.createDataFrame(
        [("CUSTOMER_RETURN", "o", None), ("CUSTOMER_RETURN", "o", "p"), ("SUPPLIER_RETURN", None, "p"),
         ("SUPPLIER_RETURN", "o", None), ("OTHER", "o", None), (None, "o", None)],
        "return_type string, order_id string, purchase_id string",
    )
    kept, _ = enforce_constraints(df, [return_reference_rule()])
    assert rows(kept) == [("CUSTOMER_RETURN", "o", None), ("SUPPLIER_RETURN", None, "p")]


def test_rule_that_is_null_is_kept(spark):
    df = spark.createDataFrame([(None,)], "n int")
    assert check_rows(df, [Rule("x", F.col("n") > 0)]).first().record_status == "pending"


def test_specs_are_consistent(spark):
    assert len(ENTITIES) == 17
    for spec in ENTITIES.values():
        names = [f.name for f in spec.staged]
        assert len(set(names)) == len(names)
        assert set(spec.required) <= set(names), spec.name
        used = {s for f in spec.staged for s in ((f.source,) if isinstance(f.source, str) else f.source or ())}
        assert used - set(spec.raw_columns) <= {"cash_transaction_id"}, spec.name
        assert spec.rules("raw__")
    assert ENTITIES["cash_transaction"].raw_name("Transaction_ID") == "cash_transaction_id"
    assert set(table_constraints()) <= set(FACTS)


def test_messages_are_built_for_breaking_rows_only(spark):
    df = spark.createDataFrame([(1, 5), (2, -5), (3, None), (4, -1)], "id int, n int")
    both = [not_negative("n"), Rule("id is even.", df["id"] % 2 == 0)]
    kept, broken = enforce_constraints(df, both)
    assert sorted(r.id for r in kept.collect()) == [1, 3] and kept.columns == df.columns
    assert {r.id: r.errors for r in broken.collect()} == {
        2: ["n cannot be negative.", "id is even."], 4: ["n cannot be negative.", "id is even."],
    }
    assert "array(" not in kept._jdf.queryExecution().optimizedPlan().toString()
    everything, nothing = enforce_constraints(df, [])
    assert everything.count() == 4 and nothing.count() == 0
