"""Rejected rows once more: their payloads as VARIANT, corrected, typed and checked again.

A rejected row keeps its raw cells as one JSON object. Read as VARIANT, each cell is a path of it, so no schema
has to be stated for 17 entities, and a correction may name just the cells it changes. NULL cells are absent from
a payload; in a correction an absent cell is left alone and an explicit null empties it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyspark.operators.joins import missing_from
from tallyspark.sources.csv_source import row_hash
from tallyspark.sources.ledger import ERRORS, BatchLedger
from tallyspark.sources.specs import ENTITIES, EntitySpec
from tallyspark.sources.staging import insert_new_staged, quarantine_rows, type_and_check
from tallyspark.sources.tables import TableStore

ROW, PAYLOAD, CORRECTION = "source_row_identifier", "raw_payload", "correction"


def cell(payload: Column, name: str) -> Column:
    """The text of one cell; NULL where the payload has none or is no JSON object."""
    return F.try_variant_get(payload, f"$.{name}", "string")


def payload_cells(rejected: DataFrame, spec: EntitySpec) -> DataFrame:
    """The rejected rows with their raw cells as columns again."""
    payload = F.try_parse_json(F.col(PAYLOAD))
    others = [c for c in rejected.columns if c not in spec.raw_columns]
    return rejected.select(*others, payload.alias("__payload")).select(
        *others, *[cell(F.col("__payload"), c).alias(c) for c in spec.raw_columns]
    )


def corrected_rows(rejected: DataFrame, spec: EntitySpec, batch_id: str, corrections: DataFrame | None = None) -> DataFrame:
    """Raw rows made of payloads, with the cells their corrections name put in place.

    ``corrections`` has one JSON object (``correction``) per ``source_row_identifier``; one that is no JSON is
    as if it were not there, and of several for a row the greatest text counts. Without it all rows come as they
    were, to meet rules that have changed since; with it only the rows it names.
    """
    rows = rejected.select(ROW, "source_row_number", "ingested_at", F.try_parse_json(F.col(PAYLOAD)).alias("__payload"))
    if corrections is None:
        rows = rows.withColumn("__change", F.lit(None).cast("variant"))
    else:
        one = corrections.groupBy(ROW).agg(F.max(CORRECTION).alias(CORRECTION))
        rows = rows.join(one.select(ROW, F.try_parse_json(F.col(CORRECTION)).alias("__change")), ROW)
    cells = []
    for c in spec.raw_columns:
        named = F.try_variant_get("__change", f"$.{c}", "variant").isNotNull()
        cells.append(F.when(named, cell(F.col("__change"), c)).otherwise(cell(F.col("__payload"), c)).alias(c))
    rows = rows.select(*cells, F.col(ROW).alias("raw_id"), "source_row_number", "ingested_at", F.lit(batch_id).alias("ingestion_batch_id"))
    return rows.withColumn("source_row_hash", row_hash(spec.raw_columns))


def replayed(rejected: DataFrame, spec: EntitySpec, batch_id: str, corrections: DataFrame | None = None) -> DataFrame:
    """Corrected rows, typed and checked as staging does."""
    return type_and_check(corrected_rows(rejected, spec, batch_id, corrections), spec)


def replay(store: TableStore, entity: str, batch_id: str, corrections: DataFrame | None = None) -> tuple[int, int]:
    """Stage rejected rows again under a batch of their own; gives how many were accepted and rejected this time.

    The rejected rows stay as they are. Accepted ones keep their row id and are staged under ``batch_id``, once:
    repeating a replay, or one whose driver was lost, adds only what is not there yet. The next replay of the same
    rows needs another batch id and makes newer versions. Rows that break a rule again go to the error ledger.
    ``load_facts(batches=[batch_id])`` then brings the accepted ones in.
    """
    spec, ledger = ENTITIES[entity], BatchLedger(store)
    staged = store.read("staging", entity)
    if staged is None:
        return 0, 0
    ledger.open(spec.table, batch_id)
    try:
        rejected = staged.where((F.col("record_status") == "invalid") & (F.col("ingestion_batch_id") != batch_id))
        versions = rejected.withColumn("ingested_at", F.current_timestamp())
        with store.sides():
            checked = store.aside(replayed(versions, spec, batch_id, corrections), "staging", f"{entity}__replay")
            accepted, refused = _append(store, entity, checked, staged.where(F.col("ingestion_batch_id") == batch_id))
    except Exception as exc:
        ledger.fail(batch_id, spec.table, str(exc))
        raise
    ledger.complete(batch_id, spec.table, accepted + refused, accepted, refused)
    return accepted, refused


def _append(store: TableStore, entity: str, checked: DataFrame, staged: DataFrame) -> tuple[int, int]:
    accepted, refused = Observation(), Observation()
    good = insert_new_staged(checked.where("record_status = 'pending'"), staged).observe(accepted, F.count(F.lit(1)).alias("n"))
    store.append(good, "staging", entity, partition_by=["ingestion_batch_id", "record_status"])
    bad = quarantine_rows(checked)
    known = store.read("ops", ERRORS)
    if known is not None:
        bad = missing_from(bad, known, ["ingestion_batch_id", "source_table", ROW])
    store.append(bad.observe(refused, F.count(F.lit(1)).alias("n")), "ops", ERRORS)
    return accepted.get.get("n", 0), refused.get.get("n", 0)


def still_rejected(store: TableStore, entities: Sequence[str] = tuple(ENTITIES)) -> DataFrame | None:
    """Rejected rows of the error ledger that no replay has accepted since."""
    errors = store.read("ops", ERRORS)
    for entity in entities if errors is not None else ():
        staged = store.read("staging", entity)
        if staged is not None:
            pending = staged.where("record_status = 'pending'").select("source_table", ROW)
            errors = missing_from(errors, pending, ["source_table", ROW])
    return errors
