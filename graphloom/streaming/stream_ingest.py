"""Incremental ingest of fact files with Structured Streaming."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from graphloom.engine import Engine
from graphloom.sources import schema


def start_ingest(engine: Engine, facts: str, checkpoint: str, files_per_batch: int = 100, version=lambda batch_id: datetime.now(UTC)) -> StreamingQuery:
    """Indexes every new Parquet file of facts, at most files_per_batch at a time, until none is left. Definitions are first-writer-
    wins; calls are appended, so of a batch that failed halfway the calls may be there twice after it is run again (as with any
    re-index; traversals use distinct edges)."""
    stream = engine.spark.readStream.schema(schema.OCCURRENCES).option("maxFilesPerTrigger", files_per_batch).parquet(facts)

    def store(batch: DataFrame, batch_id: int) -> None:
        engine.index(batch, version(batch_id))

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
