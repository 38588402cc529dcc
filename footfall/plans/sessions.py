"""Sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.config import DEFAULT, Config
from footfall.functions import ids
from footfall.operators import lookback
from footfall.sources.staging import stage

# Taken from the session's first event; mostly constant in it.
FROM_FIRST = (
    "user_agent",
    "device",
    "location",
    "landing_page",
    "source_referrer",
    "utm",
    "clid",
    "is_ext_session",
    "is_stub_session",
    "no_client_id",
)


def metric_counts(cfg: Config = DEFAULT) -> list[Column]:
    """Configured conditional counts over events; those that count once at most are 0 or 1."""
    out = []
    for metric in cfg.session_metrics:
        count = F.count_if(F.expr(metric.condition))
        if metric.once:
            count = F.when(count > 0, 1).otherwise(0).cast("long")
        out.append(count.alias(metric.name))
    return out


def session_rows(sessionated: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row per (session, client, hash), before attribution and filters.

    What is taken from the first event is mostly constant.  Where it does vary, the
    earliest counts, and at one instant the smallest.  It is carried along as text, so each
    task sorts its events, but only one state of a session and task moves, and moves once.
    Ids move packed.
    """
    key = ["session_id", "client_id", "hash"]
    us = F.unix_micros("timestamp")
    client, visitor = F.col("client_id"), F.col("hash")
    moved = sessionated.withColumns(
        {
            "session_id": ids.packed(F.col("session_id")),
            "client_id": ids.packed_beside(client, visitor),
            "hash": ids.packed(visitor),
        }
    )
    return (
        moved.groupBy(*key)
        .agg(
            F.timestamp_micros(F.min(us)).alias("start_ts"),
            F.timestamp_micros(F.max(us)).alias("end_ts"),
            F.min(F.struct(us.alias("us"), *FROM_FIRST)).alias("first"),
            F.count_if(F.col("event_name") == "pageview").alias("pageviews"),
            F.count_if(F.col("event_type") == "event").alias("events"),
            F.count(F.lit(1)).alias("hits"),
            *metric_counts(cfg),
        )
        .withColumns(
            {
                "session_id": ids.unpacked(F.col("session_id")),
                "client_id": ids.unpacked_beside(client, ids.unpacked(visitor)),
                "hash": ids.unpacked(visitor),
                **{name: F.col("first")[name] for name in FROM_FIRST},
            }
        )
        .withColumnsRenamed({"is_ext_session": "is_external", "is_stub_session": "is_stub"})
        .drop("first")
    )


def sessions(
    sessionated: DataFrame, cfg: Config = DEFAULT, rows: DataFrame | None = None
) -> DataFrame:
    """Attributed sessions without bots and stubs, one row per session id.

    ``rows`` takes ready ``session_rows``, written.  Bots and stubs take no source and are
    left out, but lend theirs; a session whose bot flag is unknown is left out too.
    """
    rows = stage(session_rows(sessionated, cfg), "session_rows") if rows is None else rows
    session, client, visitor = F.col("session_id"), F.col("client_id"), F.col("hash")
    best = Window.partitionBy("session_id").orderBy(
        F.col("donor_start_ts").desc_nulls_last(), ids.unpacked(visitor)
    )
    return (
        lookback.attribute(rows.filter(~F.col("device.is_bot") & ~F.col("is_stub")), cfg, rows)
        .withColumns(
            {
                "session_id": ids.packed(session),
                "client_id": ids.packed_beside(client, visitor),
                "hash": ids.packed(visitor),
            }
        )
        .withColumn("rank", F.row_number().over(best))
        .filter("rank = 1")
        .drop("rank")
        .withColumns(
            {
                "session_id": ids.unpacked(session),
                "client_id": ids.unpacked_beside(client, ids.unpacked(visitor)),
                "hash": ids.unpacked(visitor),
            }
        )
    )
