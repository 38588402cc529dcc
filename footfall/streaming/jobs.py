"""Structured Streaming jobs."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from footfall import schema
from footfall.config import DEFAULT, Config
from footfall.plans.reports import burst_flags
from footfall.sources.dimensions import ensured_salts
from footfall.sources.events import append_events, read_events, stored_schema
from footfall.sources.hits import process_hits
from footfall.sources.incremental import refresh_sessionated


def _run(writer: DataStreamWriter, checkpoint: str, available_now: bool) -> DataStreamWriter:
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if available_now else writer


def read_hits(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Landed hits as a stream: JSON files, one hit per line."""
    reader = spark.readStream.schema(schema.HITS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def ingest(
    hits: DataFrame,
    salts_path: str,
    path: str,
    checkpoint: str,
    geo: DataFrame | None = None,
    blank_ids_as_null: bool = True,
    available_now: bool = True,
) -> StreamingQuery:
    """Landed hits to the raw events table, each exactly once.

    Days without a salt get one before their first hits are hashed.  A micro-batch
    that is repeated replaces its own rows.
    """
    spark = hits.sparkSession
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        days = batch.select(F.to_date("received_at").alias("salt_date"))
        salts = ensured_salts(spark, salts_path, days)
        events = process_hits(batch, salts, geo, blank_ids_as_null)
        append_events(events, path, f"{stream}-{number}")

    return _run(hits.writeStream.foreachBatch(write), checkpoint, available_now).start()


def live_sessions(
    events: DataFrame, cfg: Config = DEFAULT, delay: str = "10 minutes"
) -> DataFrame:
    """Provisional activity blocks per visitor, emitted once closed.

    The session window keeps an event that comes exactly one gap after the
    last, and the block rule compares whole milliseconds, hence the extra
    999 microseconds.
    """
    gap = f"{cfg.gap_ms * 1000 + 999} microseconds"
    return (
        events.withWatermark("timestamp", delay)
        .groupBy(F.session_window("timestamp", gap).alias("w"), "hash")
        .agg(
            F.max("timestamp").alias("block_end"),
            F.count(F.lit(1)).alias("events"),
            F.count_if(F.col("event_name") == "pageview").alias("pageviews"),
        )
        .select("hash", F.col("w.start").alias("block_start"), "block_end", "events", "pageviews")
    )


def live_bursts(
    events: DataFrame, limit: int = 100, window: str = "1 minute", delay: str = "10 minutes"
) -> DataFrame:
    """Visitors with more than ``limit`` events in a minute, as a stream."""
    return burst_flags(events.withWatermark("timestamp", delay), limit, window)


def write_stream(
    rows: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append a stream's rows to Parquet files."""
    writer = rows.writeStream.format("parquet").outputMode("append")
    return _run(writer, checkpoint, available_now).start(path)


def sessionate_stream(
    spark: SparkSession,
    events_path: str,
    target_path: str,
    checkpoint: str,
    cfg: Config = DEFAULT,
    files_per_batch: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Keep the sessionated table up to date with the raw events table.

    Replacing whole days makes a repeated batch harmless.
    """
    reader = spark.readStream.schema(stored_schema())
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    arrived = reader.parquet(events_path).select("timestamp")

    def refresh(batch: DataFrame, _: int) -> None:
        refresh_sessionated(read_events(spark, events_path), target_path, batch, cfg)

    return _run(arrived.writeStream.foreachBatch(refresh), checkpoint, available_now).start()
