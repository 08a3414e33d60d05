"""Structured Streaming: new items are assigned to frozen centroids; arms gather rewards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetsieve.operators.vectors import nearest_centroid


def assign_stream(items: DataFrame, centroids: DataFrame, path: str, checkpoint: str, group: str = "class"):
    """Appends each micro-batch of (item_id, x) with its partition to a table partitioned by part_id."""

    def write(batch: DataFrame, _: int) -> None:
        nearest_centroid(batch, centroids, group).write.mode("append").partitionBy("part_id").parquet(path)

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def arm_rewards(labels: DataFrame) -> DataFrame:
    """Running reward_sum and pull_count of each arm from a stream of (target, part_id, label)."""
    return labels.groupBy("target", "part_id").agg(F.sum(F.col("label").cast("double")).alias("reward_sum"), F.count("*").cast("double").alias("pull_count"))


def windowed_hits(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Hits and events in time windows with a watermark, in append mode."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "target").agg(F.sum("label").alias("hits"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "target", "hits", "n")


def run_to_memory(stream: DataFrame, name: str, mode: str = "complete", between: Callable[[], None] | None = None) -> DataFrame:
    """Runs a stream over what is there now into a memory table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if between:
        between()
    return stream.sparkSession.table(name)
