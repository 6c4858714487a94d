"""Batch ledger: append-only events, state derived."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.sources.tables import TableStore

LEDGER = "ingestion_batches"
ERRORS = "ingestion_errors"
EVENT_SCHEMA = (
    "batch_id string, source_name string, status string, records_received bigint, records_loaded bigint, "
    "records_rejected bigint, error_message string"
)


class BatchLedger:
    """Writes one small row per batch event; nothing is updated in place."""

    def __init__(self, store: TableStore):
        self.store = store

    def open(self, source_name: str, batch_id: str | None = None) -> str:
        batch_id = batch_id or str(uuid.uuid4())
        self._event(batch_id, source_name, "running", None, None, None, None)
        return batch_id

    def complete(self, batch_id: str, source_name: str, received: int, loaded: int, rejected: int) -> None:
        self._event(batch_id, source_name, "completed", received, loaded, rejected, None)

    def fail(self, batch_id: str, source_name: str, message: str) -> None:
        self._event(batch_id, source_name, "failed", None, None, None, message)

    def _event(self, *values) -> None:
        row = self.store.spark.createDataFrame([values], EVENT_SCHEMA)
        self.store.append(row.withColumn("event_time", F.current_timestamp()), "ops", LEDGER)

    def state(self) -> DataFrame:
        events = self.store.read("ops", LEDGER)
        return batch_state(events)


def batch_state(events: DataFrame) -> DataFrame:
    """Latest event per batch, with the time the batch was opened."""
    fields = [c for c in events.columns if c not in ("batch_id", "event_time")]
    return (
        events.groupBy("batch_id")
        .agg(
            F.max_by(F.struct(*fields), "event_time").alias("last"),
            F.min("event_time").alias("started_at"),
            F.max("event_time").alias("updated_at"),
        )
        .select("batch_id", "last.*", "started_at", "updated_at")
    )
