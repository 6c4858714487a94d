"""Reading, row identity and lineage cuts shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words, and a word, as a regular expression of Java, RE2 and Python alike.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where none is set and all tasks run on this machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that all executors see in spark.checkpoint.dir")
        folder = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="tallyspark-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the shared folder, so that a lost executor costs no lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """The rows of ``df``, written to the shared folder as Parquet and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_keyed(df: DataFrame, name: str = "_row") -> tuple[DataFrame, str]:
    """``df`` with a key that tells its rows apart, even equal ones, and the name of that column.

    The key is the place of the row in its Parquet file, the same for every scan and every retried
    task. Rows that are not simply read from Parquet files, but joined or made otherwise, are written to one first.
    """
    name = fresh(df, name)

    def keyed(source: DataFrame) -> DataFrame:
        place = source.metadataColumn("_metadata")
        return source.select(
            "*", F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at")).alias(name)
        )

    def only_read(plan) -> bool:
        children = plan.children()
        own = plan.nodeName() in ("Project", "Filter", "LogicalRelation", "SubqueryAlias") and children.size() <= 1
        return own and all(only_read(children.apply(n)) for n in range(children.size()))

    if only_read(df._jdf.queryExecution().analyzed()):
        try:
            return keyed(df), name
        except AnalysisException:  # the relation is no file source
            pass
    return keyed(stored(df, "rows")), name


def text_of(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def null_last(column: Column) -> list[Column]:
    """Fields that sort as ``column`` does, with null after every value, inside min(struct(...))."""
    return [column.isNull(), column]


def with_kept_rows(docs: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` whose key is in ``keys``; the keys, a few bytes each, are the hashed side of the shuffle."""
    return docs.join(keys.select(name).hint("shuffle_hash"), name, "left_semi").drop(name)
