"""Event streams: duplicates within a watermark, sessions, and accesses merged a batch.

Each function takes a batch or a streaming DataFrame; state is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engramic.operators.store import access_merged


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """First of the events with equal keys that come within the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, began, events of each session; a session ends when no event comes for the gap."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return grouped.select("user_id", F.unix_micros("w.start").alias("began"), "events")


def merge_accesses(accesses: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Feeds `apply(merged, batch_id)` one row an id for each micro-batch; `apply` must bear a repeated batch_id."""
    writer = accesses.writeStream.foreachBatch(lambda batch, n: apply(access_merged(batch), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
