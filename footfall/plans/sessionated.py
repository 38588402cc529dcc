"""Events with sessions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.config import DEFAULT, Config
from footfall.functions import ga4, ids, urls
from footfall.functions.device import flag_bots
from footfall.operators import attribution, identity, timeline
from footfall.sources.events import PARTITION, with_day
from footfall.sources.staging import stage

#: Tasks, and so files, that a day's events are dealt out to at most.
PARTS = 64
BLOCK_COLUMNS = ("block_start", "first_id", "legacy_id")


def event_columns(cfg: Config = DEFAULT) -> dict[str, Column]:
    """Derived columns of a raw event, each from that event alone."""
    url, referrer = F.col("url"), F.col("referrer")
    return {
        "device": flag_bots(F.col("device"), F.col("user_agent"), cfg),
        "is_pageview": urls.is_pageview(F.col("event_name"), url, cfg),
        "is_ext_referrer": urls.is_ext_referrer(referrer, url, cfg),
        "referring_domain": urls.host(referrer),
        "page_location": urls.page_location(url, cfg),
        "hostname": urls.host(url),
    }


def visit_facts(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per (hash, own client id), in order of time: block, merged client and source.

    All that an event takes from its visitor's other events is a function of these
    three, so it is worked out on narrow rows, with hashes and merged ids ``packed``.
    A row holds from its ``timestamp`` on, to the next one; each slice of
    ``cfg.carry_seconds`` and each day begins with one.
    ``own_id`` is ``NOTHING`` for events without one, ``client_id`` for those that have
    just the hash.
    """
    events = events.filter(F.col("hash").isNotNull() & F.col("timestamp").isNotNull())
    events = events.withColumn("hash", ids.packed(F.col("hash")))
    active = timeline.moments(events, cfg)
    spans = timeline.spans(active, cfg).select("hash", "slice", "block_start", "block_end", "first_id")
    found = identity.with_legacy_ids(stage(spans, "spans"), active, cfg)
    merged = identity.merge_client_id(cfg, alone=F.lit(None).cast("string"))
    placed = (
        attribution.source_activity(events, cfg)
        .join(found.select("hash", "slice", *BLOCK_COLUMNS), ["hash", "slice"])
        .withColumns({"own_id": ids.packed(F.col("client_id")), **merged})
        .withColumn("client_id", F.coalesce(ids.packed(F.col("client_id")), "hash"))
        .drop("slice", "first_id", "legacy_id")
    )
    placed = stage(placed, "placed")
    sources = stage(attribution.block_sources(placed, cfg), "sources")
    nothing = F.lit(ids.NOTHING)
    asked = placed.drop("view", "signal").withColumn("own_id", F.coalesce("own_id", nothing))
    only_hash = F.col("client_id") == F.col("hash")
    runs = ["hash", "own_id", F.to_date("timestamp")]
    return attribution.with_sources(asked, sources, cfg, runs).withColumn(
        "client_id", F.when(only_hash, nothing).otherwise(F.col("client_id"))
    )


def with_facts(
    events: DataFrame, facts: DataFrame, cfg: Config = DEFAULT, days: Sequence[date] | None = None
) -> DataFrame:
    """Every event that has facts, with these; its hash packed, its own client id dropped.

    Events and facts move once, in one exchange, to the visitor's slice and meet there in
    order of time, each event with the latest fact, so the events of a session lie side by
    side.  With ``days`` only the
    events of these come out, with their day, each day in at most ``PARTS`` tasks.
    """
    visit = ["hash", "_own_id", "timestamp"]
    facts = facts.withColumnRenamed("own_id", "_own_id")
    taken = [c for c in facts.columns if c not in visit]
    own_id = F.coalesce(ids.packed(F.col("client_id")), F.lit(ids.NOTHING))
    wide = events.filter(F.col("hash").isNotNull() & F.col("timestamp").isNotNull())
    wide = wide.withColumns({"hash": ids.packed(F.col("hash")), "_own_id": own_id}).drop("client_id")
    rows = wide.unionByName(
        facts.select(*visit, F.struct(*taken).alias("_facts")), allowMissingColumns=True
    )
    near = ["hash", "_slice"]
    rows = rows.withColumn("_slice", timeline.slice_start(F.col("timestamp"), cfg.carry_seconds))
    if days is None:
        rows = rows.repartition(*near)
    else:
        part = F.pmod(F.xxhash64(*near), F.lit(PARTS))
        rows = with_day(rows).filter(F.col(PARTITION).isin(list(days))).withColumn("_part", part)
        rows = rows.repartition(PARTITION, "_part")
        near = [PARTITION, "_part", *near]
    is_event = F.col("_facts").isNull()
    facts_first = (
        Window.partitionBy(*near, "_own_id")
        .orderBy("timestamp", is_event)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("_found", F.last("_facts", ignorenulls=True).over(facts_first))
        .filter(is_event & F.col("_found").isNotNull())
        .withColumns({c: F.col("_found")[c] for c in taken})
        .drop("_own_id", "_slice", "_part", "_facts", "_found")
    )


def events_sessionated(
    events: DataFrame,
    cfg: Config = DEFAULT,
    parameters: bool = True,
    days: Sequence[date] | None = None,
) -> DataFrame:
    """Every event with its block, merged client, session and traffic source.

    ``events`` is the raw table plus ``event_id``.  The wide rows move once, to meet the
    facts of their visit.  Columns that depend on one event alone come last, so they are
    never shuffled and cost nothing if not used.  ``parameters`` adds the parsed e-commerce
    structs.  ``days`` tells whose events come out, though all of them count; they lie
    together by day.
    """
    visitor = ids.unpacked(F.col("hash"))
    merged = with_facts(events, visit_facts(events, cfg), cfg, days).withColumns(
        {"hash": visitor, "client_id": ids.unpacked_beside(F.col("client_id"), visitor)}
    )
    out = merged.withColumns({**event_columns(cfg), **attribution.session_columns()}).drop(
        "source", "block_start"
    )
    return ga4.with_parameters(out) if parameters else out
