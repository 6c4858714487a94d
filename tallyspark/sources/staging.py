"""Raw rows to staged rows: typing, rules, quarantine, incremental scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.cleaning import clean_text
from tallyspark.operators.joins import missing_from
from tallyspark.operators.rules import check_rows
from tallyspark.sources.specs import EntitySpec

SOURCE_SYSTEM = "retail_exports"
RAW_PREFIX = "raw__"
LINEAGE = (
    "source_system", "source_table", "source_row_identifier", "source_row_number", "ingestion_batch_id",
    "ingested_at", "source_hash",
)
STATUS = ("record_status", "validation_error", "error_type", "raw_payload")


def raw_rows(raw: DataFrame, batch_id: str | None = None) -> DataFrame:
    """Raw scan, of one batch or of all."""
    return raw if batch_id is None else raw.where(F.col("ingestion_batch_id") == batch_id)


def newest_batch(raw: DataFrame) -> DataFrame:
    """One row with the batch id that arrived last."""
    return raw.agg(F.max_by("ingestion_batch_id", "ingested_at").alias("ingestion_batch_id"))


def not_yet_staged(raw: DataFrame, staged: DataFrame | None) -> DataFrame:
    """Raw rows without a staged row."""
    if staged is None:
        return raw
    return missing_from(raw, staged, ["raw_id"], ["source_row_identifier"])


def settled(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same rows with ``columns`` behind a generator, past which Spark moves no filter.

    A filter on the outcome of a chain of columns would be rewritten to the columns the chain starts from, where each
    use of a column repeats all the work behind it: a handful of rules over parsers over cells grows to code no JVM
    compiles. Here each column is worked out once per row. The other columns go by and are still left out if unused.
    """
    others = [c for c in rows.columns if c not in columns]
    return rows.select(*others, F.inline(F.array(F.struct(*columns))))


def type_and_check(raw: DataFrame, spec: EntitySpec, source_system: str = SOURCE_SYSTEM) -> DataFrame:
    """Typed staging columns, lineage, and the outcome of every rule, in one pass.

    Rejected rows keep their raw cells as JSON; accepted rows do not.
    """
    raw = with_absent_raw_columns(raw, spec)
    # trimmed once here, as columns: the parsers read each cell several times
    raw = settled(raw.withColumns({c: clean_text(c) for c in spec.raw_columns}), spec.raw_columns)
    keep_raw = [F.col(c).alias(RAW_PREFIX + c) for c in spec.raw_columns]
    typed = raw.select(
        *spec.typed_columns(is_trimmed=True),
        *keep_raw,
        F.lit(source_system).alias("source_system"),
        F.lit(spec.table).alias("source_table"),
        F.col("raw_id").alias("source_row_identifier"),
        "source_row_number",
        "ingestion_batch_id",
        "ingested_at",
        F.col("source_row_hash").alias("source_hash"),
    )
    judged = [*[f.name for f in spec.staged], *[RAW_PREFIX + c for c in spec.raw_columns]]
    checked = check_rows(settled(typed, judged), spec.rules(RAW_PREFIX))
    payload = F.to_json(F.struct(*[F.col(RAW_PREFIX + c).alias(c) for c in spec.raw_columns]))
    return checked.withColumn(
        "raw_payload", F.when(F.col("record_status") == "invalid", payload)
    ).select(*[f.name for f in spec.staged], *LINEAGE, *STATUS)


def with_absent_raw_columns(raw: DataFrame, spec: EntitySpec) -> DataFrame:
    """Add raw columns a spec reads but no export carries, as NULL text."""
    wanted = set()
    for f in spec.staged:
        wanted.update(f.source if isinstance(f.source, tuple) else [f.source] if f.source else [])
    absent = sorted(wanted - set(raw.columns))
    return raw.select("*", *[F.lit(None).cast("string").alias(c) for c in absent])


def insert_new_staged(checked: DataFrame, staged: DataFrame | None) -> DataFrame:
    """Rows whose (batch, table, row id) is not staged yet."""
    key = ["ingestion_batch_id", "source_table", "source_row_identifier"]
    fresh = checked.dropDuplicates(key)
    return fresh if staged is None else missing_from(fresh, staged, key)


def quarantine_rows(checked: DataFrame) -> DataFrame:
    """Rejected rows in the form of the error ledger."""
    return checked.where(F.col("record_status") == "invalid").select(
        "ingestion_batch_id",
        "source_table",
        "source_row_number",
        "source_row_identifier",
        "error_type",
        F.col("validation_error").alias("error_message"),
        "raw_payload",
        F.col("ingested_at").alias("occurred_at"),
    )
