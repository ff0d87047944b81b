"""Structured Streaming: usage windows with late data, and incremental indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_windows(stream: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Calls and cost per service and window; rows later than ``late`` are dropped by the watermark."""
    return (
        stream.withWatermark("created_at", late)
        .groupBy(F.window("created_at", width), "service")
        .agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"))
        .select("window.start", "window.end", "service", "calls", "cost")
    )


def index_batches(stream: DataFrame, path: str, checkpoint: str, transform):
    """Write ``transform(batch)`` per micro-batch, one folder per batch id, so a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
