"""Streams of files: what a batch changes goes into versioned state; event-time windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from deltaloom.functions import text
from deltaloom.operators import statelog

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files of events."""
    reader = spark.readStream.schema(EVENTS)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by type in event-time windows; rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events once each, whatever their order within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def track_fingerprints(docs: DataFrame, folder: str, checkpoint: str, keys: list[str], body: str, order: str | None = None):
    """A query that keeps the latest fingerprint and a version of each key; unchanged keys keep their version.

    Each micro-batch appends the rows that it changed to a log of deltas (operators.statelog; read it by ``statelog.read_log``), so what it
    writes grows with the batch and not with the state; a batch that runs again is recognised by its number. Of a key that
    comes twice in a batch the row with the largest ``order`` counts, then the largest hash.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rank = F.struct(*([F.col(order)] if order else []), text.short_hash(body).alias("hash"))
        now = batch.groupBy(*keys).agg(F.max(rank).alias("last")).select(*keys, "last.hash")
        statelog.merge_batch(now, folder, keys, number)

    return docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)
