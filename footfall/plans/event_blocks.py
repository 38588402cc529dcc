"""Events with blocks and back-filled client ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.config import DEFAULT, Config
from footfall.operators import carry, identity, timeline
from footfall.sources.staging import stage

def block_facts(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per (hash, timestamp): the block's end and ids, and the next id ahead.

    A function of visitor and time, so it is worked out on one narrow row for each.
    """
    active = stage(timeline.activity(events, cfg, ("client_id",)), "activity")
    found = timeline.spans(active, cfg)
    fixed = identity.repaired_ids(active, found, cfg)
    slices = found.join(fixed, ["hash", "block_start"], "left").select(
        "hash", "slice", "block_start", "block_end", "sole_id", "fixed_id"
    )
    slices = stage(slices, "spans")

    def placed(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.join(slices.select("hash", "slice", "block_start", *columns), ["hash", "slice"])

    asked = timeline.with_slices(timeline.instants(events, "hash"), cfg)
    asked = placed(asked, "block_end", "sole_id", "fixed_id").drop("slice")
    asked = stage(asked.withColumn("us", F.unix_micros("timestamp")), "instants")
    bin_us = cfg.bin_seconds * carry.SECOND
    seen = identity.sightings(active).withColumn(
        "slice", F.col("us") - F.pmod("us", F.lit(bin_us))
    )
    return carry.in_force(
        asked,
        placed(seen),
        ["hash", "block_start"],
        cfg.bin_seconds,
        ahead=True,
    ).select(
        "hash", "timestamp", "block_end", "sole_id", "fixed_id", F.col("value").alias("upcoming")
    )


def backfilled(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Every event with ``block_end`` and the client id after each pass.

    ``tracked_client_id`` is what was collected.  ``pass1`` adds the next id
    first seen later in the block, ``pass2`` the block's only id or else the
    visitor hash, and ``pass3`` overrides with the repaired id, if any.

    The events move once, to meet the facts of their instant.  That side has one
    row per key, so the adaptive skew join can split any hot key.
    """
    return (
        events.withColumnRenamed("client_id", "tracked_client_id")
        .join(block_facts(events, cfg), ["hash", "timestamp"])
        .withColumn("pass1", F.coalesce("tracked_client_id", "upcoming"))
        .withColumn("pass2", F.coalesce("pass1", "sole_id", "hash"))
        .withColumn("pass3", F.coalesce("fixed_id", "pass2"))
        .withColumn("cookiebot_fix", F.col("fixed_id").isNotNull().cast("int"))
        .drop("sole_id", "fixed_id", "upcoming")
    )


def event_blocks(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The finished model: ``client_id`` after all passes."""
    return (
        backfilled(events, cfg)
        .withColumn("client_id", F.col("pass3"))
        .drop("pass1", "pass2", "pass3")
    )
