"""Client identity within activity blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.config import DEFAULT, Config
from footfall.operators import timeline
from footfall.sources.staging import stage


def first_client_ids(events: DataFrame) -> DataFrame:
    """First time each client id was seen on each visitor hash."""
    return (
        events.filter(F.col("client_id").isNotNull())
        .groupBy("hash", "client_id")
        .agg(F.min("timestamp").alias("timestamp"))
    )


def ids_per_block(active: DataFrame, found: DataFrame) -> DataFrame:
    """First and last time of each client id in each block."""
    return (
        active.filter(F.col("client_id").isNotNull())
        .join(found.select("hash", "slice", "block_start", "block_end"), ["hash", "slice"])
        .groupBy("hash", "block_start", "client_id")
        .agg(
            F.max("block_end").alias("block_end"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
        )
    )


def first_client_ids_per_block(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """First time each client id was seen in each block."""
    active = timeline.activity(events, cfg, ("client_id",))
    found = timeline.spans(active, cfg)
    return ids_per_block(active, found).select(
        "hash", "block_start", "client_id", F.col("first_ts").alias("timestamp")
    )


def is_legacy(ts: Column, cfg: Config = DEFAULT) -> Column:
    """The event is older than the legacy cutoff."""
    if cfg.legacy_id_cutoff is None:
        return F.lit(False)
    return ts < F.lit(cfg.legacy_id_cutoff).cast("timestamp")


def with_legacy_ids(found: DataFrame, active: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Add ``legacy_id``: the id that old events of a block take.

    It is the second of a block's client ids if there are exactly two, else the
    first.  With two ids the later one is simply the maximum, so nothing is
    collected.  Blocks that start after the cutoff are not looked at, nor is what
    happened after the last older block, so none of that moves.  ``found`` should be a
    written table, since it is read more than once.
    """
    is_old = is_legacy(F.col("block_start"), cfg)
    old = found.filter(is_old)
    until = old.select(F.max("block_end")).scalar()
    second = (
        ids_per_block(active.filter(F.col("first_ts") <= until), old)
        .groupBy("hash", "block_start")
        .agg(
            F.count(F.lit(1)).alias("ids"),
            F.max(F.struct("first_ts", "client_id"))["client_id"].alias("second_id"),
        )
        .filter("ids = 2")
        .drop("ids")
    )
    repaired = (
        old.join(second, ["hash", "block_start"], "left")
        .withColumn("legacy_id", F.coalesce("second_id", "first_id"))
        .drop("second_id")
    )
    return repaired.unionByName(found.filter(~is_old).withColumn("legacy_id", F.col("first_id")))


def merge_client_id(cfg: Config = DEFAULT, alone: Column | None = None) -> dict[str, Column]:
    """Columns for rows that carry ``first_id`` and ``legacy_id``.

    An event keeps its own client id; without one it takes the block's first
    id, and without any the visitor hash (or ``alone``).  Events before the cutoff
    always take the block's (repaired) id.
    """
    own, first = F.col("client_id"), F.col("first_id")
    legacy = is_legacy(F.col("timestamp"), cfg)
    alone = F.col("hash") if alone is None else alone
    from_block = F.when(legacy, F.col("legacy_id")).otherwise(first)
    return {
        "client_id": F.when(own.isNotNull() & ~legacy, own).otherwise(
            F.coalesce(from_block, alone)
        ),
        "no_client_id": first.isNull() & own.isNull(),
    }


def merged_client_ids(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Every event with ``block_start``, merged ``client_id``, ``no_client_id``."""
    active = stage(timeline.activity(events, cfg, ("client_id",)), "activity")
    found = with_legacy_ids(stage(timeline.spans(active, cfg), "blocks"), active, cfg)
    columns = ("block_start", "first_id", "legacy_id")
    return (
        timeline.with_blocks(events, cfg, columns, found)
        .withColumns(merge_client_id(cfg))
        .drop("first_id", "legacy_id")
    )


def repaired_ids(active: DataFrame, found: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per block with exactly two non-overlapping client ids: the later one.

    An id does not overlap if its neighbours, in order of first sighting, end
    before it starts and start after it ends.  Neighbours are looked up inside
    a slice first, then across slices from one row per slice, so a block with
    very many ids does not go through one task.
    """
    ids = ids_per_block(active, found).withColumn(
        "slice", timeline.slice_start(F.col("first_ts"), cfg.bin_seconds)
    )
    block = ["hash", "block_start"]
    inside = Window.partitionBy(*block, "slice").orderBy("first_ts", "client_id")
    across = Window.partitionBy(*block).orderBy("slice")
    edges = (
        ids.groupBy(*block, "slice")
        .agg(
            F.min("first_ts").alias("head_first"),
            F.max(F.struct("first_ts", "client_id", "last_ts"))["last_ts"].alias("tail_last"),
        )
        .withColumn("before", F.lag("tail_last").over(across))
        .withColumn("after", F.lead("head_first").over(across))
        .drop("head_first", "tail_last")
    )
    before = F.coalesce(F.lag("last_ts").over(inside), F.col("before"))
    after = F.coalesce(F.lead("first_ts").over(inside), F.col("after"))
    return (
        ids.join(edges, [*block, "slice"])
        .withColumns({"before": before, "after": after})
        .filter(F.col("before").isNull() | (F.col("before") < F.col("first_ts")))
        .filter(F.col("after").isNull() | (F.col("after") > F.col("last_ts")))
        .groupBy(*block)
        .agg(
            F.count(F.lit(1)).alias("ids"),
            F.max(F.struct("last_ts", "client_id"))["client_id"].alias("fixed_id"),
        )
        .filter("ids = 2")
        .drop("ids")
    )


def sightings(active: DataFrame) -> DataFrame:
    """When each visitor's client ids were first seen: hash, us, value.

    Of several at one instant the smallest counts.
    """
    first = (
        active.filter(F.col("client_id").isNotNull())
        .groupBy("hash", "client_id")
        .agg(F.min("first_ts").alias("seen_at"))
    )
    return first.groupBy("hash", F.unix_micros("seen_at").alias("us")).agg(
        F.min("client_id").alias("value")
    )
