"""Activity blocks, by time slices.

A block is a run of one visitor's events without a pause longer than the gap.
A slice is a stretch of the clock no longer than the gap, so all events of a
visitor in one slice are in the same block.  Hence:

* ``activity`` reduces the raw events to one row per visitor and slice (finer
  keys where asked), combining on the map side: copies and bursts collapse
  before anything moves;
* ``spans`` finds the blocks by one window per visitor over those slices, at
  most 17,520 half-hour slices a year however many events the visitor has;
* events take their block by an equi-join on (hash, slice).

No step ever brings the events of one visitor, or of one block, together in one
task, so one visitor may own any share of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.config import DEFAULT, Config


def slice_start(ts: Column, seconds: int) -> Column:
    """Start of the clock slice, in epoch microseconds."""
    micros = F.unix_micros(ts)
    return micros - F.pmod(micros, F.lit(seconds * 1_000_000))


def with_slices(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return events.withColumn("slice", slice_start(F.col("timestamp"), cfg.bin_seconds))


def moments(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``activity`` of each event by itself: what is reduced from it moves once."""
    return with_slices(events, cfg).select(
        "hash",
        "slice",
        "client_id",
        F.col("timestamp").alias("first_ts"),
        F.col("timestamp").alias("last_ts"),
        F.lit(1).alias("n"),
    )


def activity(
    events: DataFrame,
    cfg: Config = DEFAULT,
    keys: tuple[str, ...] = (),
    **extra: Column,
) -> DataFrame:
    """First and last time and row count per (hash, slice, *keys)."""
    return (
        with_slices(events, cfg)
        .groupBy("hash", "slice", *keys)
        .agg(
            F.min("timestamp").alias("first_ts"),
            F.max("timestamp").alias("last_ts"),
            F.count(F.lit(1)).alias("n"),
            *[column.alias(name) for name, column in extra.items()],
        )
    )


def spans(active: DataFrame, cfg: Config = DEFAULT, summed: tuple[str, ...] = ()) -> DataFrame:
    """Block of each (hash, slice): ``block_start``, ``block_end``.

    ``pause_ms`` is the pause before the slice's first event.  Where
    ``active`` is kept per ``client_id``, ``first_id`` is the block's first
    client id and ``sole_id`` its only one, if there is just one.  Counts named
    in ``summed`` are kept per slice.
    """
    with_ids = "client_id" in active.columns
    aggs = [
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.sum("n").alias("n"),
        *[F.sum(c).alias(c) for c in summed],
    ]
    if with_ids:
        seen = F.when(F.col("client_id").isNotNull(), F.struct("first_ts", "client_id"))
        aggs += [
            F.min(seen).alias("first_seen"),
            F.min("client_id").alias("low_id"),
            F.max("client_id").alias("high_id"),
        ]
    slices = active.groupBy("hash", "slice").agg(*aggs)

    by_time = Window.partitionBy("hash").orderBy("slice")
    running = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_block = Window.partitionBy("hash", "block_start")

    pause = F.timestamp_diff("MILLISECOND", F.lag("last_ts").over(by_time), F.col("first_ts"))
    out = (
        slices.withColumn("pause_ms", pause)
        .withColumn(
            "opens", F.col("pause_ms").isNull() | (F.col("pause_ms") > F.lit(cfg.gap_ms))
        )
        .withColumn(
            "block_start",
            F.last(F.when(F.col("opens"), F.col("first_ts")), ignorenulls=True).over(running),
        )
        .withColumn("block_end", F.max("last_ts").over(in_block))
    )
    if with_ids:
        low, high = F.min("low_id").over(in_block), F.max("high_id").over(in_block)
        out = (
            out.withColumn("first_id", F.min("first_seen").over(in_block)["client_id"])
            .withColumn("sole_id", F.when(low == high, low))
            .drop("first_seen", "low_id", "high_id")
        )
    return out


def block_starts(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row per block: its first timestamp and the pause before it."""
    rows = spans(activity(events, cfg), cfg).filter("opens")
    return rows.select(
        "hash", F.col("block_start").alias("timestamp"), F.col("pause_ms").alias("time_diff_ms")
    )


def block_ends(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row per block: its last timestamp and the pause after it."""
    by_time = Window.partitionBy("hash").orderBy("slice")
    ahead = F.timestamp_diff("MILLISECOND", F.col("last_ts"), F.lead("first_ts").over(by_time))
    return (
        spans(activity(events, cfg), cfg)
        .withColumn("time_diff_ms", ahead)
        .filter(F.col("last_ts") == F.col("block_end"))
        .select("hash", F.col("block_end").alias("timestamp"), "time_diff_ms")
    )


def with_blocks(
    events: DataFrame,
    cfg: Config = DEFAULT,
    columns: tuple[str, ...] = ("block_start", "block_end"),
    found: DataFrame | None = None,
) -> DataFrame:
    """Add block columns to every event; ``found`` takes ready ``spans``.

    The block side has one row per key, so a hot (hash, slice) is split by the
    adaptive skew join.
    """
    found = spans(activity(events, cfg), cfg) if found is None else found
    return (
        with_slices(events, cfg)
        .join(found.select("hash", "slice", *columns), ["hash", "slice"])
        .drop("slice")
    )


def block_summary(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per block: end, events and pageview events."""
    views = F.count_if(F.col("event_name") == "pageview")
    return (
        spans(activity(events, cfg, pageviews=views), cfg, ("pageviews",))
        .groupBy("hash", "block_start")
        .agg(
            F.max("block_end").alias("block_end"),
            F.sum("n").alias("events"),
            F.sum("pageviews").alias("pageviews"),
        )
    )


def instants(events: DataFrame, *keys: str) -> DataFrame:
    """The different times of each key, narrow and combined on the map side."""
    return events.select(*keys, "timestamp").distinct()
