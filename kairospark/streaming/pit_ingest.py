"""Streaming ingest of vintages: each micro-batch is an upsert, so redelivery changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kairospark.operators.pit import PitTable


def stream_into(stream: DataFrame, table: PitTable, checkpoint: str) -> StreamingQuery:
    """Starts a query that upserts every batch of observations, the last of repeated keys winning, and stops when all available input is in."""
    return stream.writeStream.foreachBatch(lambda batch, _: table.upsert(batch, last_wins=True)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
