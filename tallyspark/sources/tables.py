"""Warehouse layers as parquet folders below one shared path."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.upsert import keyed_rows

MONTH = "load_month"
LAYERS = ("raw", "staging", "core", "analytics", "ops")
VERSION, POINTERS = "version", "_versions"
PART = "part_folder"
#: Layers that are laid out by names, such as those of batches.
TEXT_PARTS = ("raw", "staging")
#: States whose files stay, for readers that opened one of them.
KEPT_STATES = 2


class TableStore:
    """Reads and writes the tables of a warehouse.

    ``base`` has to be visible to every executor (a shared file system or
    object store).

    Tables that are replaced or merged keep their files in version folders.
    A state of such a table is a small pointer file that names the folders it
    consists of; a write makes a new version beside the others and then puts
    one pointer in place. Until then nothing has changed for anybody, so a
    driver lost at any step leaves the old state, and the write can be run
    again. Readers see one state, never parts of two. A table has one writer
    at a time: a second one fails when its pointer is there already, but on
    an object store, where a rename is no lock, that check can come too late.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")
        self._sides: list[str] = []

    def path(self, layer: str, table: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"unknown layer: {layer}")
        return f"{self.base}/{layer}/{table}"

    def exists(self, layer: str, table: str) -> bool:
        fs, path = self._at(self.path(layer, table))
        return fs.exists(path)

    def read(self, layer: str, table: str) -> DataFrame | None:
        """The table, or None when nothing was written yet."""
        root = self.path(layer, table)
        if layer in TEXT_PARTS or table.startswith("row_filters_"):
            return self._read_text_parts(root) if self.exists(layer, table) else None
        number, parts = self._state(layer, table)
        if number:
            return reduce(DataFrame.unionByName, self._frames(root, parts)).drop(VERSION) if parts else None
        return self.spark.read.parquet(root) if self.exists(layer, table) else None

    def _frames(self, root: str, parts: Sequence[str]) -> list[DataFrame]:
        """One frame of the versioned folders, one of months taken over from a plain table, which have no version in their path."""
        groups = [[p for p in parts if p.startswith(VERSION) == versioned] for versioned in (True, False)]
        read = self.spark.read.option("basePath", root)
        frames = [read.parquet(*[f"{root}/{p}" for p in own]) for own in groups if own]
        return [df if VERSION in df.columns else df.withColumn(VERSION, F.lit(None).cast("int")) for df in frames]

    def parts(self, layer: str, table: str) -> list[str]:
        """Folders of the present state, which are never written again; none for a table without states."""
        return self._state(layer, table)[1]

    def read_parts(self, layer: str, table: str, parts: Sequence[str]) -> DataFrame:
        """The rows of some month folders of a state, with the folder of each row in ``part_folder``."""
        rows = reduce(DataFrame.unionByName, self._frames(self.path(layer, table), parts))
        version = F.concat(F.lit(f"{VERSION}="), F.col(VERSION), F.lit("/"))
        return rows.withColumn(PART, F.concat(F.coalesce(version, F.lit("")), F.lit(f"{MONTH}="), F.col(MONTH))).drop(VERSION)

    def _read_text_parts(self, root: str) -> DataFrame:
        """A table whose partition values are names; a batch called 7 stays text."""
        conf, guess = self.spark.conf, "spark.sql.sources.partitionColumnTypeInference.enabled"
        before = conf.get(guess)
        conf.set(guess, "false")
        try:
            return self.spark.read.parquet(root)
        finally:
            conf.set(guess, before)

    def parts_by(self, layer: str, table: str, column: str) -> set[str]:
        """Values of the first partition column that have a folder."""
        unescape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        names = self._names(self.path(layer, table))
        return {unescape(n.partition("=")[2]) for n in names if n.startswith(f"{column}=")}

    def drop_part(self, layer: str, table: str, column: str, value: str) -> None:
        """Delete the folder of one partition value, if there is one."""
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        fs, place = self._at(f"{self.path(layer, table)}/{column}={escape(value)}")
        if fs.exists(place):
            fs.delete(place, True)

    def append(self, df: DataFrame, layer: str, table: str, partition_by: Sequence[str] = ()) -> None:
        df.write.mode("append").partitionBy(*partition_by).parquet(self.path(layer, table))

    def replace(self, df: DataFrame, layer: str, table: str) -> None:
        """Swap the content of an unpartitioned table that ``df`` may be derived from."""
        number, _ = self._state(layer, table)
        part = f"{VERSION}={number + 1}"
        df.write.mode("overwrite").parquet(f"{self.path(layer, table)}/{part}")
        self._switch(layer, table, number + 1, [part])

    def merge_by_month(
        self,
        incoming: DataFrame,
        layer: str,
        table: str,
        keys: Sequence[str],
        key_column: str,
        day_key: str = "date_key",
    ) -> set[int]:
        """Upsert facts, rewriting only the months the load touches; these are returned.

        A month is touched when a new row falls in it or when it holds the
        older version of a new row. The list of months is bounded by the
        calendar, so it may go through the driver; it becomes a partition
        filter on the read and the folders of the new version. Rows equal to
        the one stored row of their key are left out first, so a load that
        repeats old rows does not rewrite their months.
        """
        if MONTH not in incoming.columns:
            incoming = incoming.withColumn(MONTH, F.floor(F.col(day_key) / 100).cast("int"))
        with self.sides():
            return self._merge_by_month(incoming, layer, table, list(keys), key_column)

    def _merge_by_month(self, incoming: DataFrame, layer: str, table: str, keys: list[str], key_column: str) -> set[int]:
        existing = self.read(layer, table)
        # written before they are read several times: the plan behind a load is long
        loaded = self.aside(incoming, layer, f"{table}__load")
        if existing is not None:
            loaded = changed_rows(loaded, existing, keys)
        loaded = self.aside(keyed_rows(existing, loaded, keys, key_column), layer, f"{table}__next")
        number, parts = self._state(layer, table)
        if existing is None:
            self._write_months(loaded, layer, table, number + 1, [])
            return _months(loaded)
        touched = sorted(_months(loaded) | _months(existing.join(loaded.select(*keys), keys, "left_semi")))
        if not touched:
            return set()
        # a table written as plain month folders has no state yet: these folders are the parts of its first one
        parts = parts if number else [n for n in self._names(self.path(layer, table)) if n.startswith(f"{MONTH}=")]
        untouched = [p for p in parts if int(p.rpartition("=")[2]) not in touched]
        kept = existing.where(F.col(MONTH).isin(touched))
        self._write_months(merged_rows(kept, loaded, keys), layer, table, number + 1, untouched)
        return set(touched)

    def replace_months(self, df: DataFrame, layer: str, table: str, months: Sequence[int] | None = None) -> None:
        """Swap the rows of some months, or all, for those of ``df``, which may be derived from the table.

        A month without rows in ``df`` is left with none. The files of other months stay as they are.
        """
        number, parts = self._state(layer, table)
        others = [] if months is None else [p for p in parts if int(p.rpartition("=")[2]) not in months]
        self._write_months(df, layer, table, number + 1, others)

    @contextmanager
    def sides(self) -> Iterator[None]:
        """Side tables made inside are deleted at the end; those of a lost driver stay, and no other load reads them."""
        outer, self._sides = self._sides, []
        try:
            yield
        finally:
            made, self._sides = self._sides, outer
            for path in made:
                fs, place = self._at(path)
                fs.delete(place, True)

    def aside(self, df: DataFrame, layer: str, table: str) -> DataFrame:
        """Write a frame under a side name of its own and read it back, so that it is computed once."""
        path = f"{self.path(layer, table)}-{uuid.uuid4().hex}"
        self._sides.append(path)
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _write_months(self, df: DataFrame, layer: str, table: str, number: int, others: Sequence[str]) -> None:
        """A new version of the months in ``df``, then a state of these and the ``others``."""
        folder = f"{self.path(layer, table)}/{VERSION}={number}"
        # rebalancing splits a month that holds most of a load and joins small ones
        (
            df.hint("rebalance", MONTH)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy(MONTH)
            .parquet(folder)
        )
        months = [n for n in self._names(folder) if n.startswith(f"{MONTH}=")]
        self._switch(layer, table, number, sorted([*others, *(f"{VERSION}={number}/{m}" for m in months)]))

    # pointer files --------------------------------------------------------------

    def _at(self, path: str):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _names(self, path: str) -> list[str]:
        fs, place = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []

    def _states(self, layer: str, table: str) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.path(layer, table)}/{POINTERS}") if n.isdigit())

    def _parts(self, layer: str, table: str, number: int) -> list[str]:
        fs, place = self._at(f"{self.path(layer, table)}/{POINTERS}/{number:09d}")
        stream = fs.open(place)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _state(self, layer: str, table: str) -> tuple[int, list[str]]:
        """Number and folders of the present state; 0 for a table without states."""
        numbers = self._states(layer, table)
        return (numbers[-1], self._parts(layer, table, numbers[-1])) if numbers else (0, [])

    def _switch(self, layer: str, table: str, number: int, parts: Sequence[str]) -> None:
        """Put a pointer in place by a rename, then drop what no kept state names."""
        folder = f"{self.path(layer, table)}/{POINTERS}"
        fs, draft = self._at(f"{folder}/draft-{number}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(list(parts)).encode()))
        stream.close()
        pointer = self._at(f"{folder}/{number:09d}")[1]
        if fs.exists(pointer) or not fs.rename(draft, pointer):
            raise RuntimeError(f"{table}: state {number} was written by somebody else")
        self._drop_unused(layer, table)

    def _drop_unused(self, layer: str, table: str) -> None:
        root = self.path(layer, table)
        numbers = self._states(layer, table)
        used = {p for n in numbers[-KEPT_STATES:] for p in self._parts(layer, table, n)}
        for version in [n for n in self._names(root) if n.startswith(f"{VERSION}=")]:
            months = [f"{version}/{m}" for m in self._names(f"{root}/{version}") if m.startswith(f"{MONTH}=")]
            gone = [m for m in months if m not in used] if months and version not in used else []
            if len(gone) == len(months) and version not in used:
                gone = [version]
            for part in gone:
                fs, place = self._at(f"{root}/{part}")
                fs.delete(place, True)
        if len(numbers) >= KEPT_STATES:
            for month in [n for n in self._names(root) if n.startswith(f"{MONTH}=") and n not in used]:
                fs, place = self._at(f"{root}/{month}")
                fs.delete(place, True)
        for n in numbers[:-KEPT_STATES]:
            fs, place = self._at(f"{root}/{POINTERS}/{n:09d}")
            fs.delete(place, False)


def merged_rows(existing: DataFrame, loaded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows whose key is not loaded, and the loaded rows, one per key."""
    return existing.join(loaded.select(*keys), list(keys), "left_anti").unionByName(loaded.select(*existing.columns))


def changed_rows(loaded: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that are new, differ from the stored row of their key in any column, or have several stored rows.

    The stored rows are first cut to the keys of the load, which for a small
    load is a broadcast and no shuffle of the table.
    """
    keys = list(keys)
    known = existing.join(loaded.select(*keys), keys, "left_semi").select(*loaded.columns)
    # one row per key: a repeated key has no equal row
    once = known.groupBy(*keys).agg(
        F.count("*").alias("__rows"), F.first(F.struct(*[c for c in loaded.columns if c not in keys])).alias("__row")
    ).where("__rows = 1")
    stored = once.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col("__row")[c].alias(f"__{c}") for c in loaded.columns])
    same = [
        F.col(c) == F.col(f"__{c}") if c in keys else F.col(c).eqNullSafe(F.col(f"__{c}")) for c in loaded.columns
    ]
    return loaded.join(stored, same, "left_anti")


def _months(df: DataFrame) -> set[int]:
    return {row[0] for row in df.select(MONTH).distinct().collect()}
