from decimal import Decimal

import pytest

from tallyspark.operators.combine import IncompatibleResults, combine_results, duplicate_keys
from tests.conftest import rows


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_scalars(spark):
    a, b = frame(spark, [(Decimal("1.5"),)], "a decimal(12,2)"), frame(spark, [(2,)], "b bigint")
    assert rows(combine_results([(a, ["a"]), (b, ["b"])], [])) == [(Decimal("1.50"), 2)]


def test_missing_key_is_zero_and_null_stays_null(spark):
    a = frame(spark, [("x", 1), ("y", None), (None, 5)], "k string, a int")
    b = frame(spark, [("y", 2), ("z", 3), (None, 7)], "k string, b int")
    assert rows(combine_results([(a, ["a"]), (b, ["b"])], ["k"])) == [(None, 5, 7), ("x", 1, 0), ("y", None, 2), ("z", 0, 3)]


def test_several_keys_and_three_results(spark):
    a = frame(spark, [("x", 1, 10)], "k string, p int, a int")
    b = frame(spark, [("x", 1, 20), ("x", 2, 21)], "k string, p int, b int")
    c = frame(spark, [], "k string, p int, c int")
    got = combine_results([(a, ["a"]), (b, ["b"]), (c, ["c"])], ["k", "p"])
    assert rows(got) == [("x", 1, 10, 20, 0), ("x", 2, 0, 21, 0)]


def test_all_sides_empty(spark):
    a, b = frame(spark, [], "k string, a int"), frame(spark, [], "k string, b int")
    assert rows(combine_results([(a, ["a"]), (b, ["b"])], ["k"])) == []


def test_errors(spark):
    a = frame(spark, [("x", 1)], "k string, a int")
    other = frame(spark, [("x", 1, 2)], "k string, extra int, b int")
    for bad in ([(a, ["a"]), (a, ["a"])], [(a, ["a"]), (other, ["b"])], [(a, ["nope"])], []):
        with pytest.raises(IncompatibleResults):
            combine_results(bad, ["k"])


def test_duplicate_keys(spark):
    a = frame(spark, [("x", 1), ("x", 2), ("y", 1)], "k string, a int")
    assert rows(duplicate_keys(a, ["k"])) == [("x", 2)]
