"""Entity names are resolved without sending a side whole through the driver."""

from tallyspark.operators import resolve as rs


def test_no_broadcast(spark):
    values = spark.createDataFrame([("Mill Road Store",), ("road store",), ("ill r",), ("nowhere",), (None,)], "said string")
    directory = spark.createDataFrame([("1", "Mill Road Store"), ("2", "Road Store North"), ("3", "Harbour")], "id string, name string")
    found = rs.resolve_entities(values, "said", directory)
    rows = {(r.said, r.status, r.resolved, r.match_count) for r in found.collect()}
    assert rows == {
        ("Mill Road Store", "resolved", "1", 1), ("road store", "ambiguous", None, 2), ("ill r", "resolved", "1", 1),
        ("nowhere", "not_found", None, 0), (None, "not_found", None, 0),
    }
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
