"""Readings that keep coming: each micro-batch is merged as a batch is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..jobs.tables import append_readings


def stream_readings(incoming: DataFrame, path: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Merge a stream of readings into the table at `path`, for the data at hand.

    First wins within a micro-batch and against what is stored, so a micro-batch that is run again after a
    failure adds nothing twice.
    """

    def merge(batch: DataFrame, _: int) -> None:
        append_readings(batch.sparkSession, path, batch, order)

    return incoming.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
