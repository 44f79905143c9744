"""Windows over streams of events and upserts; stateful.py has what needs a user's past.

ts is a TIMESTAMP. Aggregates are given out once the watermark has passed their window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_metrics(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, mode, n, avg_latency of closed windows."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "mode").agg(F.count("*").alias("n"), F.round(F.avg("latency"), 1).alias("avg_latency")).select(F.col("w.start").alias("start"), "mode", "n", "avg_latency")


def sliding_usage(events: DataFrame, width: str = "60 seconds", slide: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """start, user_id, n of sliding windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def upsert_stream(chunks: DataFrame, path: str, checkpoint: str, compact_every: int = 100):
    """Start a query that loads every micro-batch into the ChunkTable under path, by its number, so a batch can be run again.

    A batch writes its own rows only; the deltas of ``compact_every`` batches are merged into the base at once.
    """
    from tideline.sources.chunk_table import ChunkTable

    def write(batch: DataFrame, number: int) -> None:
        table = ChunkTable(batch.sparkSession, path)
        table.load(batch, number)
        if len(table.about["loads"]) >= compact_every:
            table.compact()

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
