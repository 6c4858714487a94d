"""Distinct counts that can be kept and merged: exact ones as bitmaps, approximate ones as sketches.

A count of distinct values cannot be added up over days, a state of it can. Over a dense key, such as a
surrogate key, the state is a bitmap in buckets of 32,768 keys, and the union of any days gives the exact
count without the rows. Over any other value it is an HLL sketch of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET, BITS, SKETCH = "key_bucket", "key_bits", "key_sketch"
#: 2^SKETCH_SIZE registers of a sketch.
SKETCH_SIZE = 14


def bitmaps(rows: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """``by``, bucket and bitmap of the keys of each group. ``key`` counts from 1, NULL is no key.

    Bitmaps are built before the shuffle, so a group with most of the rows sends one bitmap per bucket and task.
    """
    known = rows.where(F.col(key).isNotNull())
    state = F.bitmap_construct_agg(F.bitmap_bit_position(F.col(key))).alias(BITS)
    return known.groupBy(*by, F.bitmap_bucket_number(F.col(key)).alias(BUCKET)).agg(state)


def distinct_by_bitmap(states: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Exact number of distinct keys in the union of the states of each group; 0 for no states and no groups."""
    union = states.groupBy(*by, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))
    count = F.coalesce(F.sum(F.bitmap_count(BITS)), F.lit(0)).alias(name)
    return union.groupBy(*by).agg(count) if by else union.agg(count)


def sketches(rows: DataFrame, value: str, by: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """``by`` and a sketch of the values of each group, of at most 2^size bytes."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(value, size).alias(SKETCH))


def distinct_by_sketch(states: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Estimated number of distinct values in the union of the states of each group; 0 for no states and no groups."""
    count = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(SKETCH)), F.lit(0)).alias(name)
    return states.groupBy(*by).agg(count) if by else states.agg(count)


def standard_error(size: int = SKETCH_SIZE) -> float:
    """Relative standard error of a union of sketches; one estimate in 20 is off by more than twice this."""
    return 1.04 / math.sqrt(2**size)
