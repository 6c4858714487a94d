"""A corpus pipeline: each stage applies one operator to all documents that its predecessor kept.

Documents without a recognised language go, then exact copies, near copies and documents that hold a
benchmark passage; the rest is mixed to the target weights of the sources. Every stage takes what its
operator takes: nulls in any column, empty and very long texts, repeated rows, empty tables and further
columns; which rows stay in such cases is said there. All stages but the last keep the columns as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import common, decontaminate, exact_dedup, language_id, mixing, near_copies

#: Near copies have a Jaccard similarity of 0.8 or more of their distinct five-word shingles.
NEAR = {"shingle": 5, "least": 0.8}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of the stage's own input outside the held-out fold."""
    return language_id.accepted(docs, docs.where(language_id.fold("doc_id", 5) != 0))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.without_near_copies(docs, **NEAR)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, with copy_no."""
    return mixing.mixed(docs)


STAGES = [
    ("language id", language),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("benchmark decontamination", benchmark),
    ("mixing to target weights", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows after the last stage; what a stage keeps is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The network and the fingerprints are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None
