"""Statistics over question-evaluation results held in tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators.rules import Rule, broken_messages

COMPARED_FIELDS = ("metrics", "dimensions", "filters", "time_grain")

# Compared field or failed stage -> name of the failure.
FIELD_FAILURES = {
    "metrics": "metric_mismatch",
    "dimensions": "dimension_mismatch",
    "filters": "filter_mismatch",
    "time_grain": "time_grain_mismatch",
}
STAGE_FAILURES = {
    "parser": "parser_failure",
    "semantic_resolution": "semantic_resolution_failure",
    "time_resolution": "time_resolution_failure",
    "planning": "planning_failure",
    "sql_compilation": "sql_construction_failure",
    "execution": "execution_failure",
    "result_merge": "result_merge_failure",
}
UNEXPECTED, PIPELINE, UNKNOWN = "unexpected_error", "pipeline_failure", "unknown_mismatch"

CASE_SCHEMA = (
    "id string, question string, category string, difficulty string, expected_status string, "
    "expected struct<metrics: array<string>, dimensions: array<string>, "
    "filters: array<struct<field: string, operator: string, value: string>>, time_grain: string, time_range: string>, "
    "expected_failed_stage string, failure_reason string, notes string"
)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a dataset file: a list, or an object with ``cases``."""
    case = T.StructType.fromDDL(CASE_SCHEMA)
    schema = T.StructType([T.StructField("cases", T.ArrayType(case)), *case.fields])
    rows = spark.read.schema(schema).json(path, multiLine=True)
    listed = rows.where(F.col("cases").isNull()).drop("cases")
    return listed.unionByName(rows.where(F.col("cases").isNotNull()).select(F.inline("cases")))


def case_errors(cases: DataFrame) -> DataFrame:
    """Cases with what is wrong with them: repeated id, or a field their status needs."""
    repeated = cases.groupBy("id").agg(F.count("*").alias("__n")).where("__n > 1")
    marked = cases.join(repeated, "id", "left")
    rules = [
        Rule("id is repeated.", F.col("__n").isNotNull()),
        Rule("a success case needs expected.", (F.col("expected_status") == "success") & F.col("expected").isNull()),
        Rule(
            "a failure case needs expected_failed_stage.",
            (F.col("expected_status") == "failure") & F.col("expected_failed_stage").isNull(),
        ),
    ]
    checked = marked.withColumn("errors", broken_messages(rules)).drop("__n")
    return checked.where(F.size("errors") > 0)


def compare_cases(expected: DataFrame, actual: DataFrame, key: str = "case_id") -> DataFrame:
    """Names of the fields that differ per case, and whether the case passed.

    Both frames hold the compared fields under the same names; a case without
    an actual row differs in every field that was expected.
    """
    a = actual.select(F.col(key).alias("__key"), *[F.col(f).alias(f"__{f}") for f in COMPARED_FIELDS])
    both = expected.join(a, expected[key] == F.col("__key"), "left")
    differs = [F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), F.lit(f)) for f in COMPARED_FIELDS]
    diffs = F.array_compact(F.array(*differs))
    return both.select(*expected.columns, diffs.alias("field_diffs")).withColumn("passed", F.size("field_diffs") == 0)


def accuracy(total: Column, passed: Column) -> Column:
    return F.round(F.coalesce(passed * 100.0 / F.nullif(total, F.lit(0)), F.lit(0.0)), 2)


def evaluation_breakdown(results: DataFrame, groups: Sequence[str] = ("category", "difficulty")) -> DataFrame:
    """Totals and accuracy overall and per value of each group, in one pass."""
    sets = [[], *[[g] for g in groups]]
    total, passed = F.count("*"), F.count_if(F.col("passed"))
    which = F.lit("overall")
    for g in reversed(groups):
        which = F.when(F.grouping(g) == 0, F.lit(g)).otherwise(which)
    counted = results.groupingSets(sets, *groups).agg(
        which.alias("breakdown"),
        total.alias("total"),
        passed.alias("passed"),
        (total - passed).alias("failed"),
        accuracy(total, passed).alias("accuracy"),
    )
    value = F.coalesce(*groups)
    return counted.select("breakdown", value.alias("value"), "total", "passed", "failed", "accuracy")


def failed_cases(results: DataFrame) -> DataFrame:
    return results.where(~F.coalesce(F.col("passed"), F.lit(False))).select("case_id")


def failure_types(
    status: Column, stage: Column, diffs: Column
) -> Column:
    """All failure names of one failed result."""
    by_stage = F.create_map(*[F.lit(x) for pair in STAGE_FAILURES.items() for x in pair])
    by_field = F.create_map(*[F.lit(x) for pair in FIELD_FAILURES.items() for x in pair])
    stopped = F.when(stage == "unexpected_error", F.array(F.lit(UNEXPECTED))).otherwise(
        F.array_compact(F.array(F.lit(PIPELINE), F.try_element_at(by_stage, F.coalesce(stage, F.lit("")))))
    )
    differed = F.transform(diffs, lambda d: F.coalesce(F.try_element_at(by_field, d), F.lit(UNKNOWN)))
    found = F.when(status == "failure", stopped).otherwise(F.coalesce(differed, F.array().cast("array<string>")))
    return F.when(F.size(found) == 0, F.array(F.lit(UNKNOWN))).otherwise(found)


def failure_counts(results: DataFrame) -> DataFrame:
    """How often each kind of failure occurs; one result may count several times."""
    failed = results.where(~F.coalesce(F.col("passed"), F.lit(False)))
    kinds = failure_types(F.col("actual_status"), F.col("actual_failed_stage"), F.col("field_diffs"))
    return failed.select(F.explode(kinds).alias("failure_type")).groupBy("failure_type").agg(F.count("*").alias("failures"))


def timing_summary(log: DataFrame, keys: Sequence[str], duration: str) -> DataFrame:
    """Count, total, average, smallest and largest duration per name and labels."""
    return log.groupBy(*keys).agg(
        F.count("*").alias("count"),
        F.sum(duration).alias("total_ms"),
        F.avg(duration).alias("average_ms"),
        F.min(duration).alias("min_ms"),
        F.max(duration).alias("max_ms"),
    )
