"""Windows, deduplication and latest state over event streams; each transformation works on batch frames too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATENESS = "1 hour"


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed Parquet files as a stream, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)


def timed(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """With ts as an instant and a watermark on it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def windowed(events: DataFrame, size: str, slide: str | None = None, key: str = "event_type") -> DataFrame:
    """Count and sum of values for each tumbling or sliding window and key."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id") -> DataFrame:
    """Events of each key's sessions; a session ends after a gap."""
    out = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """First event of each key; a stream forgets keys behind the watermark."""
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def latest(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last event of each key."""
    rest = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(*key, "last.*")


def run_available(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Process everything that has landed, batch by batch, and stop; a checkpoint keeps what was done."""
    stream.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
