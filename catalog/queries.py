"""Every operator as a query over the provided tables.

Structs are flattened to scalar columns, arrays exploded or joined to text, and
timestamps given without a zone, so results compare with plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import fixtures
from footfall.config import DEFAULT
from footfall.functions import ga4, network, urls
from footfall.functions.device import flag_bots, parse_agent
from footfall.functions.ids import plain_hash
from footfall.operators import attribution, event_ids, identity, lookback, timeline
from footfall.plans import event_blocks, performance, quality, reports, rollup
from footfall.plans import sessions as session_models
from footfall.plans.sessionated import events_sessionated
from footfall.sources import dimensions, events, hits, incremental, models, rollup_refresh
from footfall.sources.once import names
from footfall.sources.staging import new_folder, remove, stage
from footfall.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def col(name: str) -> Column:
    return F.col(name)


def plain(column: Column) -> Column:
    return column.cast("timestamp_ntz")


def shown(df: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns asked for, timestamps without a zone."""
    out = df.select(*columns) if columns else df
    times = [f.name for f in out.schema.fields if f.dataType.typeName() == "timestamp"]
    return out.withColumns({c: plain(F.col(c)) for c in times}) if times else out


def fields(struct: str, names: tuple[str, ...], prefix: str = "") -> list[Column]:
    return [F.col(f"{struct}.{n}").alias(prefix + n) for n in names]


UTM = urls.UTM_FIELDS
CLID = ("parameter", "value")


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.load(spark, sf_dir)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking events without ids of their own; ``position`` is the table's id."""
    return tracked(spark, sf_dir).withColumnRenamed("event_id", "position")


def latest(table: DataFrame, column: str = "timestamp") -> Column:
    return table.select(F.max(column)).scalar()


SESSION_INPUT = (
    "event_id", "timestamp", "event_type", "event_name", "url", "user_agent", "hash", "client_id",
    "user_id", "device", "location", "session_id", "block_id", "source_referrer", "landing_page",
    "utm", "clid", "is_stub_session", "is_ext_session", "is_source_event", "no_client_id",
)


def sessionated_table(spark: SparkSession, sf_dir: str, *unread: str) -> DataFrame:
    """The sessionated events, written once for the models that read them, but for ``unread``."""
    rows = events_sessionated(tracked(spark, sf_dir), parameters=False)
    return stage(rows.select(*SESSION_INPUT).drop(*unread), "events_sessionated")


def session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_models.sessions(events_sessionated(tracked(spark, sf_dir), parameters=False))


# --- Scans and columns of single events --------------------------------------


@query
def events_scan(spark, sf_dir):
    return shown(
        tracked(spark, sf_dir),
        "event_id", "timestamp", "event_type", "event_name", "parameters", "user_agent", "url",
        "referrer", "client_id", "hash", "user_id", "consent_given",
        col("device.type").alias("device_type"),
        col("device.brand").alias("device_brand"),
        col("location.country").alias("country"),
    )


@query
def event_ids_content(spark, sf_dir):
    """Ids without a position, over a table in which every row stands twice."""
    rows = raw_events(spark, sf_dir).drop("position")
    named = event_ids.with_event_ids(rows.unionByName(rows))
    return named.groupBy("hash").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("event_id").alias("ids")
    )


def _event_ids(spark, sf_dir):
    return event_ids.with_event_ids(raw_events(spark, sf_dir), position="position")


QUERIES["event_ids"] = lambda spark, sf_dir: shown(
    _event_ids(spark, sf_dir), "position", "hash", "timestamp", "event_id"
)


@query
def bot_flag(spark, sf_dir):
    device = flag_bots(col("device"), col("user_agent"))
    return tracked(spark, sf_dir).select("event_id", device.alias("d")).select(
        "event_id", col("d.type").alias("device_type"), "d.is_bot", "d.is_bot_old"
    )


@query
def pageviews(spark, sf_dir):
    flag = urls.is_pageview(col("event_name"), col("url"))
    return tracked(spark, sf_dir).select("event_id", "event_name", flag.alias("is_pageview"))


@query
def ext_referrers(spark, sf_dir):
    flag = urls.is_ext_referrer(col("referrer"), col("url"))
    return tracked(spark, sf_dir).select("event_id", "referrer", flag.alias("is_ext_referrer"))


@query
def referring_domain(spark, sf_dir):
    return tracked(spark, sf_dir).select(
        "event_id", urls.host(col("referrer")).alias("referring_domain")
    )


@query
def click_ids(spark, sf_dir):
    rows = tracked(spark, sf_dir).select("event_id", urls.click_id(col("url")).alias("clid"))
    return rows.select("event_id", *fields("clid", CLID))


@query
def utm_parse(spark, sf_dir):
    rows = tracked(spark, sf_dir).select("event_id", urls.utm(col("url")).alias("utm"))
    return rows.select("event_id", *fields("utm", UTM))


@query
def page_location(spark, sf_dir):
    return tracked(spark, sf_dir).select(
        "event_id", urls.page_location(col("url")).alias("page_location")
    )


@query
def hostnames(spark, sf_dir):
    return tracked(spark, sf_dir).select(
        "event_id",
        urls.host(col("url")).alias("hostname"),
        urls.domain(col("url")).alias("domain"),
    )


# --- Blocks and identity -------------------------------------------------------


@query
def block_starts(spark, sf_dir):
    return shown(timeline.block_starts(tracked(spark, sf_dir)))


@query
def block_ends(spark, sf_dir):
    return shown(timeline.block_ends(tracked(spark, sf_dir)))


@query
def blocks(spark, sf_dir):
    return shown(timeline.block_summary(tracked(spark, sf_dir)))


@query
def event_blocks_start(spark, sf_dir):
    rows = timeline.with_blocks(tracked(spark, sf_dir), columns=("block_start",))
    return shown(rows, "event_id", "hash", "timestamp", "block_start")


QUERIES["event_block_starts"] = QUERIES.pop("event_blocks_start")
QUERIES["event_blocks"] = lambda spark, sf_dir: shown(
    timeline.with_blocks(tracked(spark, sf_dir), columns=("block_end",)),
    "event_id", "hash", "timestamp", "block_end",
)


@query
def first_client_ids(spark, sf_dir):
    return shown(identity.first_client_ids(tracked(spark, sf_dir)))


@query
def first_client_ids_block(spark, sf_dir):
    return shown(identity.first_client_ids_per_block(tracked(spark, sf_dir)))


@query
def client_ids(spark, sf_dir):
    rows = identity.merged_client_ids(tracked(spark, sf_dir))
    return shown(rows, "event_id", "block_start", "client_id", "no_client_id")


LEGACY = replace(DEFAULT, legacy_id_cutoff="2024-01-16")


@query
def legacy_client_ids(spark, sf_dir):
    rows = identity.merged_client_ids(tracked(spark, sf_dir), LEGACY)
    return shown(rows, "event_id", "block_start", "client_id", "no_client_id")


def _backfill(*columns: str) -> Query:
    def run(spark, sf_dir):
        return shown(event_blocks.backfilled(tracked(spark, sf_dir)), "event_id", *columns)

    return run


QUERIES["backfill_pass1"] = _backfill("block_end", "tracked_client_id", "pass1")
QUERIES["backfill_pass2"] = _backfill("pass2")
QUERIES["backfill_pass3"] = _backfill("pass3", "cookiebot_fix")


@query
def event_blocks_model(spark, sf_dir):
    return shown(
        event_blocks.event_blocks(tracked(spark, sf_dir)),
        "event_id", "timestamp", "hash", "event_name", "url", "block_end", "tracked_client_id",
        "client_id", "cookiebot_fix",
    )


# --- Sources and sessions ------------------------------------------------------


def _candidates(spark, sf_dir):
    rows = identity.merged_client_ids(tracked(spark, sf_dir))
    views = attribution.with_signals(rows).filter("is_pageview")
    return attribution.source_candidates(
        views.select(*attribution.BLOCK, *attribution.SOURCE_FIELDS, "clid", "utm")
    )


@query
def source_candidates(spark, sf_dir):
    return shown(
        _candidates(spark, sf_dir),
        "event_id", "timestamp", "client_id", "block_start", "is_first_pageview",
        "is_ext_referrer", "landing_page", "referrer", "referring_domain", "is_direct",
        *fields("clid", CLID, "clid_"), *fields("utm", UTM, "utm_"),
    )


@query
def ext_sources(spark, sf_dir):
    return shown(
        attribution.ext_sources(_candidates(spark, sf_dir)),
        "event_id", "timestamp", "client_id", "block_start", "is_direct", "first_source",
        "landing_page", "referrer", *fields("clid", CLID, "clid_"), *fields("utm", UTM, "utm_"),
    )


@query
def utm_rules(spark, sf_dir):
    """The rules on every pageview."""
    rows = attribution.with_signals(tracked(spark, sf_dir)).filter("is_pageview")
    return rows.withColumn("utm", attribution.apply_rules()).select(
        "event_id", *fields("utm", ("source", "medium"))
    )


def _sessionated(spark, sf_dir, parameters=False):
    return events_sessionated(tracked(spark, sf_dir), parameters=parameters)


@query
def sessionated(spark, sf_dir):
    return shown(
        _sessionated(spark, sf_dir),
        "event_id", "client_id", "block_id", "session_id", "source_referrer", "landing_page",
        "is_stub_session", "is_ext_session", "is_source_event",
        *fields("utm", UTM, "utm_"), *fields("clid", CLID, "clid_"),
    )


QUERIES["events_sessionated"] = lambda spark, sf_dir: shown(
    _sessionated(spark, sf_dir, parameters=True),
    "event_id", "timestamp", "event_type", "event_name", "parameters", "user_agent", "url",
    "referrer", "client_id", "hash", "user_id", "is_pageview", "is_ext_referrer",
    "referring_domain", "page_location", "hostname", "no_client_id", "block_id", "session_id",
    "source_referrer", "landing_page", "is_stub_session", "is_ext_session", "is_source_event",
    col("device.type").alias("device_type"), col("device.is_bot").alias("is_bot"),
    *fields("utm", UTM, "utm_"), *fields("clid", CLID, "clid_"),
    col("ecommerce.value").alias("purchase_value"),
    col("view_item_data.item_id").alias("view_item_id"),
    col("add_to_cart_data.item_id").alias("cart_item_id"),
    col("begin_checkout_data.currency").alias("checkout_currency"),
    col("sign_up_data.method").alias("sign_up_method"),
    col("login_data.method").alias("login_method"),
    col("generate_lead_data.value").alias("lead_value"),
    col("page_view_data.page_title").alias("page_title"),
    col("scroll_data.percent_scrolled").alias("percent_scrolled"),
    col("video_data.video_title").alias("video_title"),
    F.size("item").cast("long").alias("items"),
)

SESSION_COLUMNS = (
    "session_id", "client_id", "hash", "start_ts", "end_ts", "user_agent", "landing_page",
    "source_referrer", "is_external", "is_stub", "no_client_id", "pageviews", "events", "hits",
    "logged_in", "activated",
)


def _session_columns() -> list[Column]:
    return [
        *[col(c) for c in SESSION_COLUMNS],
        col("device.type").alias("device_type"),
        col("device.brand").alias("device_brand"),
        col("location.country").alias("country"),
        *fields("utm", UTM, "utm_"),
        *fields("clid", CLID, "clid_"),
    ]


@query
def sessions_agg(spark, sf_dir):
    return shown(session_models.session_rows(_sessionated(spark, sf_dir)), *_session_columns())


@query
def session_metrics(spark, sf_dir):
    rows = session_models.session_rows(_sessionated(spark, sf_dir))
    return rows.select("session_id", "hash", "logged_in", "activated")


@query
def session_attribution(spark, sf_dir):
    rows = stage(session_models.session_rows(_sessionated(spark, sf_dir)), "session_rows")
    return shown(
        lookback.attribute(rows),
        "session_id", "hash", "start_ts", "donor_start_ts",
        *fields("utm", UTM, "utm_"), *fields("clid", CLID, "clid_"),
    )


@query
def sessions(spark, sf_dir):
    return shown(session_table(spark, sf_dir), *_session_columns(), col("donor_start_ts"))


ROLLUP = (
    "first_session_ts", "last_session_ts", "touchpoints", "sessions", "logged_in", "activated",
    "no_client_id",
)


def _visits(spark, sf_dir) -> DataFrame:
    return stage(session_table(spark, sf_dir), "sessions")


@query
def clients(spark, sf_dir):
    return shown(
        rollup.clients(_visits(spark, sf_dir), paths=True),
        "client_id", *ROLLUP, *fields("first_utm", UTM, "first_"), *fields("last_utm", UTM, "last_"),
    )


@query
def first_last_utm(spark, sf_dir):
    return rollup.roll_up(session_table(spark, sf_dir), "client_id").select(
        "client_id", *fields("first_utm", UTM, "first_"), *fields("last_utm", UTM, "last_")
    )


@query
def touchpoints(spark, sf_dir):
    return rollup.clients(_visits(spark, sf_dir), paths=True).select("client_id", "touchpoints")


@query
def touchpoint_rows(spark, sf_dir):
    return shown(rollup.touchpoints(session_table(spark, sf_dir)))


@query
def touchpoint_segments(spark, sf_dir):
    """Paths of clients in segments of three sessions."""
    return rollup.touchpoint_segments(session_table(spark, sf_dir), size=3)


def _users(spark, sf_dir) -> tuple[DataFrame, rollup.Owners]:
    rows = sessionated_table(spark, sf_dir, "event_id", "block_id", "is_source_event")
    found = stage(session_models.sessions(rows), "sessions")
    return found, rollup.owners(rows, found)


@query
def user_map(spark, sf_dir):
    found, whose = _users(spark, sf_dir)
    return rollup.user_map(whose, found)


@query
def users(spark, sf_dir):
    return shown(
        rollup.users(*_users(spark, sf_dir), paths=True),
        "user_id", *ROLLUP, *fields("first_utm", UTM, "first_"), *fields("last_utm", UTM, "last_"),
        "ext_sources",
    )


@query
def user_path_segments(spark, sf_dir):
    """Paths of users in segments of three sessions."""
    found, whose = _users(spark, sf_dir)
    return rollup.user_touchpoints(found, whose, size=3).filter(col("user_id").isNotNull())


@query
def user_utm_lists(spark, sf_dir):
    """The entries of the users' source lists, from segments of three."""
    rows = rollup.user_sources(*_users(spark, sf_dir), size=3).filter(col("user_id").isNotNull())
    return shown(
        rows.select("user_id", F.explode("steps").alias("entry")).select(
            "user_id",
            col("entry.position").alias("position"),
            *[col(f"entry.utm.{f}").alias(f) for f in UTM],
            col("entry.start_ts").alias("start_ts"),
        )
    )


QUERIES["daily_performance"] = lambda spark, sf_dir: shown(
    performance.daily_performance(
        # Campaign numbers stand in for ad ids.
        session_table(spark, sf_dir).withColumn(
            "utm", col("utm").withField("id", F.regexp_extract("utm.campaign", r"(\d+)", 1))
        ),
        "start_ts",
        "utm",
        ("hits", "pageviews", "activated"),
        fixtures.ads(spark, sf_dir),
    )
)


# --- Parameters ----------------------------------------------------------------


def _event_struct(column: str) -> Query:
    names, columns = ga4.STRUCTS[column]

    def run(spark, sf_dir):
        rows = ga4.with_parameters(tracked(spark, sf_dir), (column,))
        return rows.filter(col(column).isNotNull()).select(
            "event_id", "event_name", *fields(column, tuple(n for n, _ in columns))
        )

    return run


for _key, _column in {
    "ga4_purchase": "ecommerce",
    "ga4_view_item": "view_item_data",
    "ga4_add_to_cart": "add_to_cart_data",
    "ga4_begin_checkout": "begin_checkout_data",
    "ga4_sign_up": "sign_up_data",
    "ga4_login": "login_data",
    "ga4_generate_lead": "generate_lead_data",
    "ga4_page_view": "page_view_data",
    "ga4_scroll": "scroll_data",
    "ga4_video": "video_data",
}.items():
    QUERIES[_key] = _event_struct(_column)


@query
def ga4_items(spark, sf_dir):
    rows = ga4.with_parameters(tracked(spark, sf_dir), ("item",))
    return rows.select("event_id", F.posexplode("item").alias("position", "i")).select(
        "event_id", col("position").cast("long").alias("position"), "i.*"
    )


def _documented(build: Callable[[ga4.Document], list[Column]], rich: bool = True, n: int = 0) -> Query:
    def run(spark, sf_dir):
        rows = tracked(spark, sf_dir)
        rows, doc = ga4.parse(fixtures.rich_parameters(rows) if rich else rows, None, n, n)
        return rows.select("event_id", *build(doc))

    return run


NAME = "event_name"
QUERIES["ga4_currency"] = _documented(
    lambda d: [ga4.currency(d.text("currency")).alias("currency")], rich=False
)
QUERIES["ga4_category"] = lambda spark, sf_dir: tracked(spark, sf_dir).select(
    "event_id", ga4.event_category(col(NAME)).alias("category")
)
QUERIES["ga4_valid"] = _documented(
    lambda d: [ga4.is_valid_ecommerce(d, col(NAME)).alias("is_valid")]
)
QUERIES["ga4_value"] = _documented(lambda d: [ga4.value(d).alias("value")])
QUERIES["ga4_custom_dims"] = _documented(lambda d: ga4.custom_dimensions(d, 3), n=3)
QUERIES["ga4_custom_metrics"] = _documented(lambda d: ga4.custom_metrics(d, 3), n=3)


def _struct_of(build, names) -> Query:
    inner = _documented(lambda d: [build(d).alias("s")])
    return lambda spark, sf_dir: inner(spark, sf_dir).select("event_id", *fields("s", names))


QUERIES["ga4_user_props"] = _struct_of(
    ga4.user_properties, tuple(n for n, _ in ga4.USER_PROPERTIES)
)
QUERIES["ga4_traffic_source"] = _struct_of(
    ga4.traffic_source, tuple(n for n, _ in ga4.TRAFFIC_SOURCE)
)
QUERIES["ga4_device_category"] = lambda spark, sf_dir: tracked(spark, sf_dir).select(
    "event_id",
    ga4.device_category(col("device.type"), col("device.brand"), col("device.model")).alias(
        "device_category"
    ),
)
QUERIES["ga4_engagement"] = _documented(
    lambda d: [ga4.engagement_time(d).alias("engagement_time")]
)


@query
def ga4_enrich(spark, sf_dir):
    """Everything from one parse of the parameters."""
    rows = ga4.with_enrichment(fixtures.rich_parameters(tracked(spark, sf_dir)), 3, 3)
    return rows.select(
        "event_id", "category", col("is_valid_ecommerce").alias("is_valid"), "value",
        "engagement_time", "device_category",
        *[f"custom_dimension{n}" for n in (1, 2, 3)], *[f"custom_metric{n}" for n in (1, 2, 3)],
        col("user_properties.user_type").alias("user_type"),
        col("user_properties.user_tier").alias("user_tier"),
        col("traffic_source.gclid").alias("gclid"),
    )


# --- Reports -------------------------------------------------------------------


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query
def daily_kpis(spark, sf_dir):
    return rounded(reports.daily_kpis(sessionated_table(spark, sf_dir)), "avg_session_duration")


@query
def dau_growth(spark, sf_dir):
    rows = sessionated_table(spark, sf_dir)
    return rounded(reports.dau_growth(reports.daily_kpis(rows), latest(rows), 20), "growth_pct")


@query
def duration_buckets(spark, sf_dir):
    found = stage(session_table(spark, sf_dir), "sessions")
    return rounded(reports.duration_buckets(found, latest(found, "start_ts")), "percentage")


@query
def top_pages(spark, sf_dir):
    rows = sessionated_table(spark, sf_dir)
    return rounded(reports.top_pages(rows, latest(rows)), "avg_views_per_visitor")


@query
def geo_traffic(spark, sf_dir):
    rows = sessionated_table(spark, sf_dir)
    return reports.geo_traffic(rows, latest(rows), 20)


@query
def freshness(spark, sf_dir):
    rows = sessionated_table(spark, sf_dir)
    tables = {
        "events": (tracked(spark, sf_dir), "timestamp"),
        "daily_performance": (reports.daily_kpis(rows), "date"),
    }
    return shown(reports.freshness("2024-03-01 12:34:56", tables))


@query
def hourly_events(spark, sf_dir):
    return shown(reports.hourly_events(tracked(spark, sf_dir)))


@query
def client_user_map(spark, sf_dir):
    return shown(reports.client_user_map(tracked(spark, sf_dir)))


@query
def user_activity(spark, sf_dir):
    rows = reports.user_activity(sessionated_table(spark, sf_dir))
    return shown(rounded(rows, "avg_session_duration"))


@query
def session_summary(spark, sf_dir):
    rows = reports.session_summary(sessionated_table(spark, sf_dir))
    return shown(rows.withColumn("events", F.array_join("events", ",")))


@query
def anon_clients(spark, sf_dir):
    return shown(reports.anon_clients(_sessionated(spark, sf_dir)))


@query
def session_numbers(spark, sf_dir):
    rows = reports.session_numbers(tracked(spark, sf_dir))
    return shown(
        rows, "event_id", "client_id",
        col("new_session").cast("long").alias("new_session"),
        col("session_number").cast("long").alias("session_number"),
    )


@query
def daily_event_names(spark, sf_dir):
    rows = tracked(spark, sf_dir)
    return reports.daily_event_names(rows, latest(rows))


@query
def recent_events(spark, sf_dir):
    agent = "Mozilla/5.0 (X11; Linux) Firefox/100"
    rows = reports.recent_events(tracked(spark, sf_dir), 20, "pageview", agent)
    return shown(
        rows, "event_id", "timestamp", "event_name", "url", "client_id",
        col("location.country").alias("country"),
    )


@query
def quality_checks(spark, sf_dir):
    rows = sessionated_table(spark, sf_dir, "block_id", "is_source_event")
    found = stage(session_models.sessions(rows), "sessions")
    return quality.failures(quality.standard_checks(rows, found))


@query
def null_counts(spark, sf_dir):
    return quality.null_counts(tracked(spark, sf_dir))


@query
def returning_visitors(spark, sf_dir):
    return reports.returning_visitors(_sessionated(spark, sf_dir))


@query
def retention(spark, sf_dir):
    rows = reports.retention(_sessionated(spark, sf_dir))
    return rows.withColumn("week_offset", col("week_offset").cast("long"))


@query
def funnel(spark, sf_dir):
    rows = sessionated_table(spark, sf_dir)
    steps = ("pageview", "add_to_cart", "begin_checkout", "purchase")
    return reports.funnel(rows, steps).withColumn("step", col("step").cast("long"))


@query
def burst_flags(spark, sf_dir):
    return shown(reports.burst_flags(tracked(spark, sf_dir), limit=1))


@query
def retention_purge(spark, sf_dir):
    rows = events.retained(tracked(spark, sf_dir), F.lit("2025-03-11").cast("date"))
    return rows.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.count(F.lit(1)).alias("events")
    )


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The events known at first, and those that come later: half of them late."""
    rows = tracked(spark, sf_dir)
    late = (F.to_date("timestamp") == "2024-01-10") & (col("event_id") % 2 == 0)
    later = late | (F.to_date("timestamp") >= "2024-01-27")
    return rows.filter(~later), rows.filter(later)


@query
def users_incremental(spark, sf_dir):
    """Two refreshes of the daily table, the second with late rows."""
    first, later = _parts(spark, sf_dir)
    path = new_folder(spark)
    incremental.refresh_days(first, path)
    incremental.refresh_days(first.union(later), path, later)
    return shown(incremental.users_from_days(incremental.read_days(spark, path)))


def _refreshed(spark, sf_dir, *tables: str) -> str:
    """Folder of a raw table and the ``tables`` that follow from it, after two refreshes."""
    root = new_folder(spark)
    for part in _parts(spark, sf_dir):
        events.append_events(part, f"{root}/raw")
        raw = events.read_events(spark, f"{root}/raw")
        incremental.refresh_sessionated(raw, f"{root}/sessionated", part)
        done = spark.read.parquet(f"{root}/sessionated")
        if "sessions" in tables:
            incremental.refresh_sessions(done, f"{root}/sessions", part)
        if "rollups" in tables:
            visits = spark.read.parquet(f"{root}/sessions")
            rollup_refresh.refresh_rollups(done, visits, f"{root}/rollups", part)
        if "kpis" in tables:
            incremental.refresh_daily_kpis(done, f"{root}/kpis", part)
    return root


@query
def sessions_incremental(spark, sf_dir):
    rows = spark.read.parquet(f"{_refreshed(spark, sf_dir, 'sessions')}/sessions")
    return shown(rows, *_session_columns(), col("donor_start_ts"))


@query
def daily_kpis_incremental(spark, sf_dir):
    rows = spark.read.parquet(f"{_refreshed(spark, sf_dir, 'kpis')}/kpis")
    return rounded(rows, "avg_session_duration")


ROLLED_STATES = (*(c for c in ROLLUP if c != "touchpoints"), "ext_sources")


@query
def clients_incremental(spark, sf_dir):
    """Clients from states by month, after two refreshes, the second with late rows."""
    root = _refreshed(spark, sf_dir, "sessions", "rollups")
    return shown(
        rollup_refresh.refreshed_clients(spark, f"{root}/rollups"),
        "client_id", *ROLLED_STATES, *fields("first_utm", UTM, "first_"), *fields("last_utm", UTM, "last_"),
    )


@query
def users_model_incremental(spark, sf_dir):
    """Users from states by month, after two refreshes, the second with late rows."""
    root = _refreshed(spark, sf_dir, "sessions", "rollups")
    return shown(
        rollup_refresh.refreshed_users(spark, f"{root}/rollups"),
        "user_id", *ROLLED_STATES, *fields("first_utm", UTM, "first_"), *fields("last_utm", UTM, "last_"),
    )


@query
def sessionated_incremental(spark, sf_dir):
    rows = spark.read.parquet(f"{_refreshed(spark, sf_dir)}/sessionated")
    return rows.select(
        col("event_id").cast("long").alias("event_id"), "client_id", "block_id", "session_id"
    )


# --- Tables ----------------------------------------------------------------------


@query
def events_append(spark, sf_dir):
    """Two appends to the raw table; the second one repeated under its name.

    The second has every row twice, and is dealt out anew before it is repeated.
    ``kept`` are the ids that were there before the repeat.
    """
    path = new_folder(spark)
    rows = tracked(spark, sf_dir).drop("event_id")
    odd = F.pmod(F.xxhash64("hash", "timestamp"), F.lit(2)) == 1
    events.append_events(rows.filter(odd), path)
    second = rows.filter(~odd).unionByName(rows.filter(~odd))
    events.append_events(second, path, "second")
    before = stage(events.read_events(spark, path).select(events.ID), "ids_before")
    events.append_events(second.repartition(7, "url"), path, "second")
    found = events.read_events(spark, path).join(
        before.select(events.ID, F.lit(1).alias("was")), events.ID, "left"
    )
    copies = F.when(odd, 1).otherwise(2)
    return found.groupBy(col(events.PARTITION).alias("date"), "event_name").agg(
        F.sum(1 / copies).cast("long").alias("events"),
        (F.count_distinct(events.ID) - F.count(F.lit(1))).alias("ids_lacking"),
        (F.count(F.lit(1)) - F.count("was")).alias("ids_changed"),
    )


@query
def events_days(spark, sf_dir):
    """Some days of the raw table, of which only those are read."""
    path = new_folder(spark)
    events.append_events(tracked(spark, sf_dir), path)
    found = events.read_events(spark, path, date(2024, 1, 5), date(2024, 1, 9))
    return shown(found, col("event_id").cast("long").alias("event_id"), "timestamp", "event_name", "url")


@query
def published_views(spark, sf_dir):
    kpis = reports.daily_kpis(sessionated_table(spark, sf_dir))
    models.publish_views({"published_daily_kpis": rounded(kpis, "avg_session_duration")})
    return spark.table("published_daily_kpis")


@query
def published_tables(spark, sf_dir):
    """The mart by date in the development database, read back."""
    kpis = rounded(reports.daily_kpis(sessionated_table(spark, sf_dir)), "avg_session_duration")
    database = "footfall_" + spark.sql("SELECT replace(uuid(), '-', '')").first()[0]
    target = models.target_database(database, dev=True)
    spark.sql(f"CREATE DATABASE {target} LOCATION '{new_folder(spark)}'")
    models.publish_tables({"kpis": kpis}, database, dev=True, partition_by={"kpis": "date"})
    return models.read_model(spark, "kpis", database, dev=True)


# --- Ingest --------------------------------------------------------------------


def landed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = tracked(spark, sf_dir)
    return fixtures.landed_hits(rows), fixtures.salts(rows)


@query
def ingest_merge(spark, sf_dir):
    rows = hits.merge_payload(landed(spark, sf_dir)[0])
    return rows.select("event_id", "en", "url", "r", "et", "p")


@query
def ingest_defaults(spark, sf_dir):
    rows = hits.with_defaults(*landed(spark, sf_dir))
    return rows.select("event_id", "et", "ua", "c", "h", "h1", "ch")


QUERIES["client_ip"] = lambda spark, sf_dir: landed(spark, sf_dir)[0].select(
    "event_id", network.client_ip(col("headers"), col("remote_addr")).alias("ip")
)
QUERIES["ip_truncate"] = lambda spark, sf_dir: landed(spark, sf_dir)[0].select(
    "event_id",
    network.truncate_ip(
        network.sanitize_ip(network.client_ip(col("headers"), col("remote_addr")))
    ).alias("ip_trunc"),
)


@query
def visitor_hash(spark, sf_dir):
    rows = hits.with_defaults(*landed(spark, sf_dir))
    return rows.select("event_id", "h", plain_hash(col("ua")).alias("agent_hash"))


@query
def salt_retention(spark, sf_dir):
    salts = landed(spark, sf_dir)[1]
    return dimensions.retained_salts(salts, F.lit("2024-01-20 06:00:00"))


@query
def salt_upkeep(spark, sf_dir):
    """Days with events from 10 January on and their salts, made on the way.

    Some days have one, the rest is made by one job, asked for again by another, and what
    is older is deleted.
    """
    rows, path = tracked(spark, sf_dir), new_folder(spark)
    days = rows.select(F.to_date("timestamp").alias("salt_date"))
    dimensions.ensured_salts(spark, path, days.filter(F.dayofmonth("salt_date") % 3 == 0))
    first = stage(dimensions.ensured_salts(spark, path, days), "salts_read")
    again = dimensions.ensured_salts(spark, path, days)
    dimensions.purge_salts(spark, path, datetime(2024, 1, 11, 6))
    left = dimensions.read_salts(spark, path).join(again.join(first, ["salt_date", "salt"]), ["salt_date", "salt"])
    return left.select("salt_date", F.length("salt").cast("long").alias("salt_length"))


@query
def geo_enrich(spark, sf_dir):
    rows, salts = landed(spark, sf_dir)
    done = rows.withColumn(
        "ip", network.sanitize_ip(network.client_ip(col("headers"), col("remote_addr")))
    )
    found = dimensions.with_geo(done, fixtures.geo(spark, sf_dir), "ip")
    return found.select("event_id", "ip", *dimensions.GEO_FIELDS)


@query
def geo_ranges(spark, sf_dir):
    """Locations by the smallest network around an address."""
    rows, _ = landed(spark, sf_dir)
    done = rows.withColumn(
        "ip", network.sanitize_ip(network.client_ip(col("headers"), col("remote_addr")))
    )
    found = dimensions.with_geo_ranges(done, fixtures.geo_networks(spark, sf_dir), "ip")
    return found.select("event_id", "ip", "country", "country_code", "city")


@query
def device_enrich(spark, sf_dir):
    rows = landed(spark, sf_dir)[0].select(
        "event_id", parse_agent(col("headers")["user-agent"]).alias("d")
    )
    return rows.select("event_id", "d.*")


@query
def ingest_events(spark, sf_dir):
    rows, salts = landed(spark, sf_dir)
    done = hits.process_hits(rows, salts, fixtures.geo(spark, sf_dir))
    return shown(
        done,
        "timestamp", "event_type", "event_name", "parameters", "user_agent", "url", "referrer",
        "client_id", "hash", "user_id", "consent_given",
        col("device.os").alias("os"), col("location.ip_trunc").alias("ip_trunc"),
        col("location.country").alias("country"),
    )


@query
def ingest_rejects(spark, sf_dir):
    """Hits of days for which no salt was made, by day."""
    rows, salts = landed(spark, sf_dir)
    done = hits.process_hits(rows, salts.filter(col("salt_date") >= "2024-01-10"))
    lost = hits.rejected_events(done)
    return lost.groupBy(F.to_date("timestamp").alias("date"), "reason").agg(
        F.count(F.lit(1)).alias("events")
    )


@query
def ingest_salted(spark, sf_dir):
    """Events and visitors by day with salts made on the way; salts and geo rows doubled."""
    rows = landed(spark, sf_dir)[0]
    path = new_folder(spark)
    days = rows.select(F.to_date("received_at").alias("salt_date"))
    first = days.filter(col("salt_date") < "2024-01-10")
    dimensions.ensured_salts(spark, path, first)
    made = dimensions.ensured_salts(spark, path, days)
    geo = fixtures.geo(spark, sf_dir)
    done = hits.process_hits(rows, made.union(made), geo.union(geo))
    return done.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("hash").alias("visitors")
    )


@query
def hits_to_sessions(spark, sf_dir):
    """From landed hits over raw events and their ids to sessions."""
    rows, salts = landed(spark, sf_dir)
    raw = event_ids.with_event_ids(hits.process_hits(rows, salts, fixtures.geo(spark, sf_dir)))
    done = stage(events_sessionated(raw, parameters=False).select(*SESSION_INPUT), "hits_sessionated")
    found = session_models.sessions(done)
    return shown(found, "client_id", "hash", "start_ts", "end_ts", "hits", "pageviews", "is_external")


@query
def consent_ledger(spark, sf_dir):
    rows = hits.consent_ledger(*landed(spark, sf_dir))
    return shown(rows, "hash", "decided_at", "consent", col("client_id").isNotNull().alias("has_id"))


@query
def invalid_hits(spark, sf_dir):
    rejected = hits.split_hits(landed(spark, sf_dir)[0])[1]
    return rejected.select("event_id", F.array_join("reasons", "; ").alias("reasons"))


# --- Streams -------------------------------------------------------------------


@query
def live_sessions(spark, sf_dir):
    root = new_folder(spark)
    rows = jobs.live_sessions(fixtures.load_stream(spark, sf_dir))
    jobs.write_stream(rows, f"{root}/rows", f"{root}/checkpoint").awaitTermination()
    return shown(spark.read.schema(rows.schema).parquet(f"{root}/rows"))


@query
def live_bursts(spark, sf_dir):
    root = new_folder(spark)
    rows = jobs.live_bursts(fixtures.load_stream(spark, sf_dir), limit=1, window="1 hour")
    jobs.write_stream(rows, f"{root}/rows", f"{root}/checkpoint").awaitTermination()
    return shown(spark.read.schema(rows.schema).parquet(f"{root}/rows"))


@query
def ingest_stream(spark, sf_dir):
    """Landed files to the raw table, with salts made on the way.

    The job is started again as if it had been killed after the write of its last
    micro-batch, before the commit.  ``ids_kept`` are the ids that stay.
    """
    root = new_folder(spark)
    landed(spark, sf_dir)[0].drop("event_id").write.json(f"{root}/hits")

    def run() -> DataFrame:
        stream = jobs.read_hits(spark, f"{root}/hits", files_per_batch=4)
        jobs.ingest(
            stream, f"{root}/salts", f"{root}/raw", f"{root}/checkpoint", fixtures.geo(spark, sf_dir)
        ).awaitTermination()
        return events.read_events(spark, f"{root}/raw")

    before = stage(run().select(events.ID, F.lit(1).alias("was")), "ids_before")
    last = max(names(spark, f"{root}/checkpoint/commits"), key=int)
    remove(spark, f"{root}/checkpoint/commits/{last}")
    done = run().join(before, events.ID, "left")
    return done.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("hash").alias("visitors"),
        F.count_distinct(F.when(col("was") == 1, col(events.ID))).alias("ids_kept"),
    )


@query
def sessionated_stream(spark, sf_dir):
    """The sessionated table kept up to date by a stream, with late rows."""
    root = new_folder(spark)
    for part in _parts(spark, sf_dir):
        events.append_events(part, f"{root}/raw")
        jobs.sessionate_stream(
            spark, f"{root}/raw", f"{root}/sessionated", f"{root}/checkpoint"
        ).awaitTermination()
    done = spark.read.parquet(f"{root}/sessionated")
    return done.select(
        col("event_id").cast("long").alias("event_id"), "client_id", "block_id", "session_id"
    )
