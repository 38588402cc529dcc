"""Traffic sources and sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall import schema
from footfall.config import DEFAULT, Config
from footfall.functions import urls
from footfall.functions.ids import digest_id
from footfall.operators import carry, timeline

BLOCK = ["client_id", "block_start"]
SOURCE_FIELDS = (
    "timestamp",
    "event_id",
    "landing_page",
    "referrer",
    "referring_domain",
    "is_ext_referrer",
)


def source_signals(cfg: Config = DEFAULT) -> dict[str, Column]:
    """Columns of a pageview that tell where the visitor came from."""
    url, referrer = F.col("url"), F.col("referrer")
    return {
        "is_ext_referrer": urls.is_ext_referrer(referrer, url, cfg),
        "referring_domain": urls.host(referrer),
        "clid": urls.click_id(url, cfg),
        "utm": urls.utm(url),
        "landing_page": urls.page_location(url, cfg),
    }


def with_signals(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Add ``is_pageview`` and, on pageviews, the source signals.

    Only pageviews can be a source, so other rows skip the pattern matching:
    their url and referrer are NULL here.
    """
    flag = urls.is_pageview(F.col("event_name"), F.col("url"), cfg)
    view = F.col("is_pageview")
    return (
        events.withColumn("is_pageview", F.coalesce(flag, F.lit(False)))
        .withColumns({c: F.when(view, F.col(c)) for c in ("url", "referrer")})
        .withColumns(source_signals(cfg))
    )


def is_signalled() -> Column:
    return F.col("is_ext_referrer") | F.col("clid").isNotNull() | F.col("utm").isNotNull()


def source_activity(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Activity per (hash, client_id, timestamp, signal): one pass over raw.

    ``signal`` is the source key of a signalled pageview, NULL for all other
    events; ``view`` is the group's first pageview.  Everything the session
    model needs to know about other events is in this table.  The narrow rows move
    once, to the visitor's slice, and lie there by ``hash`` and ``slice``.
    """
    signal = F.struct(F.coalesce("referrer", F.lit("")).alias("referrer"), "clid", "utm")
    marked = with_signals(events, cfg).withColumn(
        "signal", F.when(F.col("is_pageview") & is_signalled(), signal)
    )
    view = F.when(F.col("is_pageview"), F.struct(*SOURCE_FIELDS))
    key = ["hash", "client_id", "timestamp", "signal"]
    narrow = timeline.with_slices(marked.select(*key, view.alias("view")), cfg)
    return narrow.repartition("hash", "slice").groupBy("slice", *key).agg(F.min("view").alias("view"))


def activity_views(active: DataFrame) -> DataFrame:
    """The pageviews in ``source_activity`` that can be a source, as rows."""
    return active.filter(F.col("view").isNotNull()).select(
        *BLOCK,
        *[F.col("view")[f].alias(f) for f in SOURCE_FIELDS],
        F.col("signal.clid").alias("clid"),
        F.col("signal.utm").alias("utm"),
    )


def source_candidates(views: DataFrame) -> DataFrame:
    """Pageviews that carry a source signal or open their (client, block).

    The opening pageviews come from a combinable aggregate and are joined back
    by event, not by block, so a block of any size stays spread out.
    """
    opening = (
        views.groupBy(*BLOCK)
        .agg(F.min(F.struct("timestamp", "event_id")).alias("opening"))
        .select(*BLOCK, "opening.event_id", F.lit(True).alias("opens"))
    )
    return (
        views.join(opening, [*BLOCK, "event_id"], "left")
        .withColumn("is_first_pageview", F.col("opens").isNotNull())
        .drop("opens")
        .filter(F.col("is_first_pageview") | is_signalled())
        .withColumn("is_direct", ~is_signalled())
    )


def apply_rules(cfg: Config = DEFAULT) -> Column:
    """``utm`` with source and medium filled in by the first matching rule."""
    utm = F.col("utm")

    def filled(source: Column, medium: Column) -> Column:
        return F.struct(
            F.coalesce(utm["source"], source).alias("source"),
            F.coalesce(utm["medium"], medium).alias("medium"),
            *[utm[f].alias(f) for f in ("campaign", "content", "term", "id")],
        )

    default = filled(F.lit("direct"), F.lit("none"))
    out = None
    for rule in cfg.rules:
        value = filled(F.expr(rule.source), F.expr(rule.medium))
        test = F.expr(rule.condition)
        out = F.when(test, value) if out is None else out.when(test, value)
    return default if out is None else out.otherwise(default)


def ext_sources(candidates: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """First occurrence of each source in a (client, block), rules applied.

    A block's first pageview is always a candidate, so ``first_source`` is just
    ``is_first_pageview``.
    """
    carried = [c for c in candidates.columns if c not in (*BLOCK, "timestamp", "event_id")]
    row = F.struct("timestamp", "event_id", *carried)
    key = [F.coalesce("referrer", F.lit("")).alias("referrer_key"), "clid", "utm"]
    return (
        candidates.select(*BLOCK, *key, row.alias("row"))
        .groupBy(*BLOCK, "referrer_key", "clid", "utm")
        .agg(F.min("row").alias("row"))
        .select(*BLOCK, "row.*")
        .withColumn("utm", apply_rules(cfg))
        .withColumn("first_source", F.col("is_first_pageview"))
    )


def block_sources(placed: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The sources of each (client, block): us, source, first_source.

    As ``ext_sources`` of ``source_candidates``, with the views reduced to one of each
    source before they meet their block's opening pageview.  ``placed`` is read twice: a
    written table.
    """
    views = activity_views(placed).withColumns(
        {"referrer_key": F.coalesce("referrer", F.lit("")), "signalled": is_signalled()}
    )
    opening = views.groupBy(*BLOCK).agg(
        F.min(F.struct("timestamp", "event_id", "signalled", "referrer_key")).alias("opening")
    )
    found = (
        views.groupBy(*BLOCK, "referrer_key", "clid", "utm", "signalled")
        .agg(F.min(F.struct(*SOURCE_FIELDS)).alias("row"))
        .join(opening, BLOCK)
        .select("*", *[F.col("row")[f].alias(f) for f in SOURCE_FIELDS])
    )
    first = F.col("opening")
    opens = (F.col("timestamp") == first["timestamp"]) & (F.col("event_id") == first["event_id"])
    # the same source as an opening pageview without a signal, so that one stands for it
    repeats = (
        ~first["signalled"]
        & first["event_id"].isNotNull()
        & (F.col("referrer_key") == first["referrer_key"])
        & F.col("clid").isNull()
        & F.col("utm").isNull()
    )
    return (
        found.withColumn("first_source", F.coalesce(opens, F.lit(False)))
        .filter(F.col("first_source") | (F.col("signalled") & ~repeats))
        .withColumns({"utm": apply_rules(cfg), "is_direct": ~F.col("signalled")})
        .select(*BLOCK, source_payload().alias("source"), "first_source")
    )


def source_payload() -> Column:
    """What a session takes from its source, ordered by time."""
    return F.struct(
        "timestamp",
        "event_id",
        F.col("referrer").alias("source_referrer"),
        "landing_page",
        "utm",
        "clid",
        "is_direct",
    )


def with_sources(
    asked: DataFrame,
    sources: DataFrame,
    cfg: Config = DEFAULT,
    runs: Sequence[Column | str] | None = None,
) -> DataFrame:
    """Add ``source``: the latest at or before ``timestamp``, else the block's first.

    No source of a block is earlier than its first, so that one counts from the block's
    start.  ``asked`` has a narrow row for each instant; both are read twice.  With
    ``runs`` only the instants come out at which the source changes, as in ``carry.in_force``.
    """
    starts = F.unix_micros("block_start")
    since = F.when(F.col("first_source"), starts).otherwise(F.unix_micros("source.timestamp"))
    values = sources.select(*BLOCK, since.alias("us"), F.col("source").alias("value"))
    rows = asked.withColumn("us", F.unix_micros("timestamp"))
    found = carry.in_force(rows, values, BLOCK, cfg.carry_seconds, opens=starts, runs=runs)
    return found.withColumnRenamed("value", "source").drop("us")


def session_columns() -> dict[str, Column]:
    """Session fields of an event from its ``source``."""
    source = F.col("source")
    visit = (F.col("client_id"), F.unix_micros("block_start"))
    block = digest_id(*visit)
    unknown = F.struct(
        F.lit("direct").alias("source"),
        F.lit("none").alias("medium"),
        *[F.lit(None).cast("string").alias(f) for f in ("campaign", "content", "term", "id")],
    ).cast(schema.UTM)
    return {
        "block_id": block,
        "session_id": F.coalesce(digest_id(*visit, source["event_id"]), block),
        "source_referrer": source["source_referrer"],
        "landing_page": source["landing_page"],
        "utm": F.coalesce(source["utm"], unknown),
        "clid": source["clid"],
        "is_stub_session": source.isNull(),
        "is_ext_session": source.isNotNull() & ~F.coalesce(source["is_direct"], F.lit(True)),
        "is_source_event": F.col("event_id") == source["event_id"],
    }
