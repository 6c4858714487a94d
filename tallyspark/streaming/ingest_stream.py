"""Exports arriving in a folder, staged continuously."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark.operators.joins import missing_from
from tallyspark.plans.warehouse_jobs import append_raw, stage
from tallyspark.sources.csv_source import add_lineage, export_rows, stream_export
from tallyspark.sources.ledger import BatchLedger
from tallyspark.sources.specs import ENTITIES
from tallyspark.sources.tables import TableStore


def ingest_stream(
    store: TableStore, entity: str, folder: str, checkpoint: str, available_now: bool = True, **options: str
) -> StreamingQuery:
    """Ingest and stage the files that appear in ``folder``.

    A micro-batch gets a batch id made of its number and row ids made of file
    and position. A micro-batch that is repeated after a failure finds its own
    rows by those ids and adds nothing twice.
    """
    spec = ENTITIES[entity]
    ledger = BatchLedger(store)

    def land(rows: DataFrame, epoch: int) -> None:
        batch_id = f"{entity}-stream-{epoch}"
        ledger.open(spec.table, batch_id)
        try:
            received, loaded = landed(rows, batch_id)
        except Exception as exc:
            ledger.fail(batch_id, spec.table, str(exc))
            raise
        ledger.complete(batch_id, spec.table, received, loaded, received - loaded)

    def landed(rows: DataFrame, batch_id: str) -> tuple[int, int]:
        named = add_lineage(export_rows(rows, spec), spec, batch_id)
        raw = store.read("raw", entity)
        if raw is not None:
            own = raw.where(F.col("ingestion_batch_id") == batch_id)
            named = missing_from(named, own, ["raw_id"])
        received, loaded = append_raw(store, named, spec, batch_id)
        stage(store, entity, batch_id)
        return received, loaded

    stream = stream_export(store.spark, folder, spec, **options)
    writer = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
