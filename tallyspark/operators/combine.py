"""Line up aggregated results that share their grouping columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class IncompatibleResults(ValueError):
    """Results that cannot be combined."""


def combine_results(results: Sequence[tuple[DataFrame, Sequence[str]]], keys: Sequence[str]) -> DataFrame:
    """One row per key of any result, the measures side by side.

    ``results`` are (frame, measure columns). A key a result lacks gives 0 for
    its measures; a NULL measure of a present row stays NULL; NULL keys are
    one key. Stacking and grouping does this in one shuffle for any number of
    results, where outer joins would lose the NULL keys and shuffle each time.
    """
    keys = list(keys)
    names = [m for _, measures in results for m in measures]
    if not results:
        raise IncompatibleResults("nothing to combine")
    if len(set(names)) != len(names):
        raise IncompatibleResults(f"measures appear twice: {names}")
    tagged = []
    for i, (df, measures) in enumerate(results):
        absent = [c for c in (*keys, *measures) if c not in df.columns]
        if absent:
            raise IncompatibleResults(f"result {i} lacks {absent}")
        extra = [c for c in df.columns if c not in keys and c not in measures]
        if extra:
            raise IncompatibleResults(f"result {i} groups by other columns: {extra}")
        tagged.append(df.select(*keys, *measures, F.lit(True).alias(f"__has{i}")))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    seen = [F.max(f"__has{i}").alias(f"__has{i}") for i in range(len(results))]
    merged = stacked.groupBy(*keys).agg(*[F.max(m).alias(m) for m in names], *seen)
    filled = [
        F.when(F.col(f"__has{i}"), F.col(m)).otherwise(F.lit(0)).alias(m)
        for i, (_, measures) in enumerate(results)
        for m in measures
    ]
    return merged.select(*keys, *filled)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys a result holds more than once; a result fit for combining has none."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).where("row_count > 1")
