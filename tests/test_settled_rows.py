"""Cells are worked out once per row, also when rows are asked for by the outcome of their rules."""

from pyspark.sql import functions as F

from tallyspark.functions import cleaning as cl
from tallyspark.sources.specs import ENTITIES
from tallyspark.sources.staging import type_and_check


def _raw(spark):
    spec = ENTITIES["order"]
    cells = [F.concat(F.lit(" "), F.col("id").cast("string")).alias(c) for c in spec.raw_columns]
    return spark.range(3).select(
        *cells, F.col("id").cast("string").alias("raw_id"), F.col("id").alias("source_row_number"), F.lit("b").alias("ingestion_batch_id"),
        F.current_timestamp().alias("ingested_at"), F.lit("h").alias("source_row_hash"),
    )


def test_no_filter_on_the_outcome_reaches_the_cells(spark):
    rejected = type_and_check(_raw(spark), ENTITIES["order"]).where("record_status = 'invalid'")
    plan = rejected._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("trim" in line for line in filters)
    assert rejected.count() == 3


def test_trimming_by_the_ends_of_a_cell(spark):
    ends = ["", " ", " ", "　", "\x1f", "!", "~", "é", "\x7f"]
    cells = [a + m + b for a in ends for b in ends for m in ("", "x", "a b")]
    got = spark.createDataFrame([(c,) for c in [*cells, None]], "c string").select("c", cl.clean_text("c").alias("t")).collect()
    assert len(got) == len(cells) + 1
    for row in got:
        assert row.t == ((row.c or "").strip(cl.WHITESPACE) or None), repr(row.c)


def test_trimmed_cells_are_read_as_others_are(spark):
    cells = ["2024-01-02", "Sat Aug 15 2026 10:11:12 GMT+0600 (Some Time)", " (x)", "3/4/2024", "1,5", "$7", "(8.5)", "-9", "yes", "1e3", "x (", None]
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select(cl.clean_text("c").alias("c"))
    parsers = [
        cl.parse_date_day_first, cl.parse_date_month_first, cl.parse_timestamp_basic, cl.parse_timestamp_wide, cl.parse_int, cl.parse_decimal,
        cl.parse_decimal_commas, cl.parse_decimal_dollars, cl.parse_amount, cl.parse_quantity, cl.parse_boolean,
    ]
    differ = rows.where(~F.array(*[p("c").eqNullSafe(p("c", is_trimmed=True)) for p in parsers]).eqNullSafe(F.array(*[F.lit(True)] * len(parsers))))
    assert differ.collect() == []
