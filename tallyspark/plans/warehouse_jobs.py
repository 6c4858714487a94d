"""Jobs that move exports through the layers: ingest, stage, dimensions, facts."""

from __future__ import annotations

import datetime as dt
from collections import ChainMap
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyspark.operators.joins import missing_from
from tallyspark.operators.rules import split_judged, table_constraints, with_errors
from tallyspark.plans.dimensions import (
    CALENDAR_END, CALENDAR_START, DIMENSIONS, calendar, extend_calendar, incoming_rows, upsert_dimension,
)
from tallyspark.plans.facts import FACTS
from tallyspark.sources.csv_source import add_lineage, first_of_each, read_export
from tallyspark.sources.known_rows import drop_known
from tallyspark.sources.ledger import ERRORS, BatchLedger
from tallyspark.sources.specs import ENTITIES, EntitySpec
from tallyspark.sources.staging import not_yet_staged, quarantine_rows, raw_rows, type_and_check
from tallyspark.sources.tables import MONTH, TableStore

DIMENSION_ORDER = ("dim_customer", "dim_product", "dim_supplier", "dim_partner", "dim_cash_account", "dim_location")
VIOLATIONS = "constraint_violations"


class StoredTables(Mapping[str, DataFrame]):
    """Staged, dimension and fact tables of a store, by the names the plans use."""

    def __init__(self, store: TableStore):
        self.store = store

    def __getitem__(self, name: str) -> DataFrame:
        df = self.store.read(*self._place(name))
        if df is None:
            raise KeyError(name)
        return df

    @staticmethod
    def _place(name: str) -> tuple[str, str]:
        return ("staging", name.removeprefix("stg_")) if name.startswith("stg_") else ("core", name)

    def __iter__(self) -> Iterator[str]:
        names = [*(f"stg_{e}" for e in ENTITIES), "dim_date", *DIMENSION_ORDER, *FACTS]
        return (n for n in names if self.store.read(*self._place(n)) is not None)

    def __len__(self) -> int:
        return sum(1 for _ in self)


def _counted(df: DataFrame, name: str, observation: Observation) -> DataFrame:
    return df.observe(observation, F.count(F.lit(1)).alias(name))


def _stored(df: DataFrame | None, columns: Sequence[str] | None = None) -> DataFrame | None:
    return df if df is None or columns is None else df.select(*columns)


def append_raw(store: TableStore, rows: DataFrame, spec: EntitySpec, batch_id: str) -> tuple[int, int]:
    """Append rows not ingested before, in a folder of their batch; (received, loaded) are counted by the writes themselves."""
    received, loaded = Observation(), Observation()
    rows = _counted(rows, "n", received)
    with store.sides():
        if spec.skip_known_rows:
            rows = drop_known(store, spec.name, first_of_each(rows), batch_id)
        store.append(_counted(rows, "n", loaded), "raw", spec.name, partition_by=["ingestion_batch_id"])
    return received.get.get("n", 0), loaded.get.get("n", 0)


def ingest(
    store: TableStore, entity: str, path: str | Sequence[str], batch_id: str | None = None, strict: bool = True,
    multi_line: bool | None = None,
) -> str:
    """Bring an export into the raw layer; returns the batch id."""
    spec, ledger = ENTITIES[entity], BatchLedger(store)
    batch_id = ledger.open(spec.table, batch_id)
    try:
        rows = add_lineage(read_export(store.spark, path, spec, strict, multi_line), spec, batch_id)
        received, loaded = append_raw(store, rows, spec, batch_id)
    except Exception as exc:
        ledger.fail(batch_id, spec.table, str(exc))
        raise
    ledger.complete(batch_id, spec.table, received, loaded, received - loaded)
    return batch_id


def stage(store: TableStore, entity: str, batch_id: str | None = None) -> None:
    """Type and check raw rows not staged yet; accepted and rejected rows are written in one pass.

    Raw and staging are laid out by batch, so a batch reads its own folders only.
    Rejected rows sit in their own partition of the staging table, from which
    the error ledger is filled.
    """
    spec = ENTITIES[entity]
    raw = store.read("raw", entity)
    if raw is None:
        return
    staged = store.read("staging", entity)
    if staged is not None:
        staged = raw_rows(staged, batch_id)  # row ids hold their batch: the history of other batches need not be read
    fresh = not_yet_staged(raw_rows(raw, batch_id), _stored(staged, ["source_row_identifier"]))
    # a row id is made of batch, file and position, so rows not staged yet cannot meet a staged twin
    store.append(type_and_check(fresh, spec), "staging", entity, partition_by=["ingestion_batch_id", "record_status"])

    written = store.read("staging", entity)
    rejected = quarantine_rows(written if batch_id is None else raw_rows(written, batch_id))
    ledger = store.read("ops", ERRORS)
    if ledger is not None:
        rejected = missing_from(rejected, ledger, ["ingestion_batch_id", "source_table", "source_row_identifier"])
    store.append(rejected, "ops", ERRORS)


def load_dimensions(store: TableStore, start: dt.date = CALENDAR_START, end: dt.date = CALENDAR_END) -> None:
    """Calendar and the six business dimensions, partners before locations."""
    tables = StoredTables(store)
    days = calendar(store.spark, start, end)
    store.replace(extend_calendar(store.read("core", "dim_date"), days), "core", "dim_date")
    for name in DIMENSION_ORDER:
        staged = store.read("staging", DIMENSIONS[name].staging)
        if staged is None:
            continue
        partners = tables["dim_partner"] if name == "dim_location" else None
        with store.sides():
            incoming = store.aside(incoming_rows(DIMENSIONS[name], staged, partners), "core", f"{name}__load")
            store.replace(upsert_dimension(name, incoming, store.read("core", name)), "core", name)


# fact -> (staging of a parent, key of the parent there, the same key in the fact's staging): a changed parent changes its lines
PARENTS = {
    "fact_sales": (("stg_order", "order_id", "order_id"),),
    "fact_return_items": (
        ("stg_return", "return_id", "return_id"),
        ("stg_order_item", "order_item_id", "order_item_id"),  # quantity and cogs sold
        ("stg_product", "product_id", "product_id"),  # present cost price
    ),
    "fact_purchases": (("stg_purchase", "purchase_id", "purchase_id"),),
}
# fact -> parents that reach it through another staging: (staging, its key, the staging between, key in that, key it has in common with the fact's)
THROUGH = {"fact_return_items": (("stg_order", "order_id", "stg_order_item", "order_id", "order_item_id"),)}


def _of_batches(tables: Mapping[str, DataFrame], fact: str, batches: Sequence[str]) -> Mapping[str, DataFrame]:
    """The tables with the fact's staging cut to keys the batches touch, in all their versions."""
    spec = FACTS[fact]
    staged, key = tables[spec.staging], spec.staging_key
    in_batch = F.col("ingestion_batch_id").isin(*batches)
    touched = staged.where(in_batch).select(key)
    for parent, parent_key, own_key in PARENTS.get(fact, ()):
        if parent in tables and own_key in staged.columns:
            parents = tables[parent].where(in_batch).select(F.col(parent_key).alias(own_key))
            touched = touched.unionByName(staged.join(parents, own_key, "left_semi").select(key))
    for parent, parent_key, between, between_key, own_key in THROUGH.get(fact, ()):
        if parent in tables and between in tables and own_key in staged.columns:
            parents = tables[parent].where(in_batch).select(F.col(parent_key).alias(between_key))
            lines = tables[between].join(parents, between_key, "left_semi").select(own_key)
            touched = touched.unionByName(staged.join(lines, own_key, "left_semi").select(key))
    return ChainMap({spec.staging: staged.join(touched, key, "left_semi")}, tables)


def load_facts(
    store: TableStore, only: Sequence[str] | None = None, constraints: str = "quarantine",
    batches: Sequence[str] | None = None,
) -> dict[str, set[int]]:
    """All facts whose staging exists, in dependency order; gives the months of each fact that were rewritten.

    Without ``batches`` all accepted rows are loaded again, which also picks
    up rows whose dimension arrived late. With them only the keys those
    batches touch are, directly or through what they depend on (PARENTS, THROUGH).
    Each fact is computed and judged once, written aside, and split from there.
    """
    stored = StoredTables(store)
    rewritten: dict[str, set[int]] = {}
    for name, spec in FACTS.items():
        if (only is not None and name not in only) or store.read("staging", spec.staging.removeprefix("stg_")) is None:
            continue
        tables = stored if batches is None else _of_batches(stored, name, batches)
        with store.sides():
            rewritten[name] = _load_fact(store, name, tables, constraints)
    return rewritten


def _load_fact(store: TableStore, name: str, tables: Mapping[str, DataFrame], constraints: str) -> set[int]:
    spec = FACTS[name]
    rows = spec.load(tables)
    if name == "fact_return_items":
        # lines have no date of their own; they lie in the month of their return
        month = F.floor(F.col("date_key") / 100).cast("int").alias(MONTH)
        rows = rows.join(tables["fact_returns"].select("return_id", month), "return_id")
    rules = table_constraints().get(name)
    if rules:
        judged = store.aside(with_errors(rows, rules), "core", f"{name}__judged")
        rows, broken = split_judged(judged, constraints)
        if constraints == "quarantine":
            report = broken.select(
                F.lit(name).alias("table_name"),
                F.concat_ws("|", *spec.business_key).alias("business_key"),
                F.array_join("errors", "; ").alias("error_message"),
                "ingestion_batch_id",
            )
            known = store.read("ops", VIOLATIONS)
            if known is not None:
                report = missing_from(report, known, ["table_name", "business_key", "ingestion_batch_id"])
            store.append(report, "ops", VIOLATIONS)
    return store.merge_by_month(rows, "core", name, spec.business_key, spec.key_column)


def run_all(store: TableStore, exports: Mapping[str, str], start: dt.date = CALENDAR_START, end: dt.date = CALENDAR_END) -> StoredTables:
    """Ingest and stage the given exports (entity -> path), then load dimensions and facts."""
    for entity, path in exports.items():
        batch = ingest(store, entity, path)
        stage(store, entity, batch)
    load_dimensions(store, start, end)
    load_facts(store)
    return StoredTables(store)
