"""Text exports to raw rows: header by name, trimmed cells, lineage columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions.cleaning import clean_text
from tallyspark.operators.joins import missing_from
from tallyspark.operators.latest import latest_per_key
from tallyspark.sources.specs import EntitySpec

BYTE_ORDER_MARK = "\ufeff"
FIRST_DATA_ROW = 2  # the header is row 1


class MissingColumns(ValueError):
    """The export lacks columns its spec names."""


def read_export(
    spark: SparkSession, path: str | Sequence[str], spec: EntitySpec, strict: bool = True, multi_line: bool | None = None
) -> DataFrame:
    """Read an export as text columns under their raw names.

    Columns are found by header name, in any order; ``strict`` raises before
    any row is read when one is missing, otherwise it becomes NULL. Files read
    together must share one header line. ``multi_line`` keeps line breaks
    inside quotes and reads each file in one task. When it is not given, the
    files are looked through for such breaks first, line by line in split
    files, and only those that have one are read whole.
    """
    paths = list(path) if not isinstance(path, str) else path
    if multi_line is None:
        multi_line = has_quoted_line_breaks(spark, paths)
    df = _csv_options(spark.read, multi_line).csv(paths)
    return export_rows(_with_position(df), spec, strict)


def has_quoted_line_breaks(spark: SparkSession, paths: str | Sequence[str]) -> bool:
    """Whether a line has an odd number of quotes, as the first line of a record with a line break in a cell has."""
    odd = spark.read.text(paths).where(F.regexp_count("value", F.lit('"')) % 2 == 1)
    return not odd.limit(1).isEmpty()


def stream_export(spark: SparkSession, folder: str, spec: EntitySpec, multi_line: bool = True, **options: str) -> DataFrame:
    """The files arriving in a folder as a stream of text rows with their position.

    A stream needs its columns up front, so files have to carry the header
    of the spec in its order; a file with another header fails the batch.
    """
    schema = ", ".join(f"`{h}` string" for h in spec.header)
    reader = _csv_options(spark.readStream, multi_line).schema(schema).options(**options)
    return _with_position(reader.csv(folder))


def _csv_options(reader, multi_line: bool):
    return (
        reader.option("header", True)
        .option("encoding", "UTF-8")
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
    )


def _with_position(df: DataFrame) -> DataFrame:
    return df.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")
    )


def export_rows(positioned: DataFrame, spec: EntitySpec, strict: bool = True) -> DataFrame:
    """Trimmed cells under raw names, with source file and row number."""
    present = {name.lstrip(BYTE_ORDER_MARK).strip(): name for name in positioned.columns}
    missing = [h for h in spec.header if h not in present]
    if missing and strict:
        raise MissingColumns(f"{spec.file}: missing columns {missing}")
    cells = [
        (clean_text(F.col(f"`{present[h]}`")) if h in present else F.lit(None).cast("string")).alias(spec.raw_name(h))
        for h in spec.header
    ]
    return _number_rows(positioned).select(
        *cells, F.col("__file").alias("source_file"), F.col("__row").cast("bigint").alias("source_row_number")
    )


def _number_rows(positioned: DataFrame) -> DataFrame:
    """Row number inside each file, without bringing a file into one task.

    Every file block counts its rows; a block starts where the blocks before
    it end. The second pass reads no text column.
    """
    marked = positioned.withColumn("__id", F.monotonically_increasing_id())
    blocks = marked.groupBy("__file", "__start").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "__file", "__start", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )
    return marked.join(offsets, ["__file", "__start"]).withColumn(
        "__row", F.col("__offset") + F.col("__id") - F.col("__first") + FIRST_DATA_ROW
    )


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 over ``name=value`` pairs in name order; NULL counts as empty, separators inside values are escaped."""
    pairs = [F.concat(F.lit(f"{c}="), F.coalesce(_escaped(F.col(c)), F.lit(""))) for c in sorted(columns)]
    return F.sha2(F.concat_ws("|", *pairs), 256)


def _escaped(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def add_lineage(df: DataFrame, spec: EntitySpec, batch_id: str, ingested_at: Column | None = None) -> DataFrame:
    """Add batch id, content hash, a row id that survives retries, and arrival time."""
    hashed = df.withColumn("source_row_hash", row_hash(spec.raw_columns)).withColumn(
        "ingestion_batch_id", F.lit(batch_id)
    )
    position = F.concat_ws("|", "ingestion_batch_id", "source_file", F.col("source_row_number").cast("string"))
    return hashed.withColumn("raw_id", F.sha2(position, 256)).withColumn(
        "ingested_at", ingested_at if ingested_at is not None else F.current_timestamp()
    )


def first_of_each(incoming: DataFrame) -> DataFrame:
    """The first row per content hash."""
    return latest_per_key(incoming, ["source_row_hash"], [-F.col("source_row_number"), F.col("source_file")])


def drop_known_rows(incoming: DataFrame, raw: DataFrame | None) -> DataFrame:
    """Keep the first row per content hash, and only hashes not yet in ``raw``."""
    first = first_of_each(incoming)
    return first if raw is None else missing_from(first, raw, ["source_row_hash"])
