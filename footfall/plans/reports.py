"""Reports over events and sessions.

Reports that count distinct values first reduce the events to one row per
combination of the values counted, on the map side, and count on those rows.
Times that the reports measure back from are passed as ``as_of``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions import ids
from footfall.operators.timeline import slice_start
from footfall.sources.staging import stage


def _when(as_of: str | Column) -> Column:
    return (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("timestamp")


def since(as_of: str | Column, days: int, column: str = "timestamp") -> Column:
    return F.col(column) >= _when(as_of) - F.make_dt_interval(F.lit(days))


def is_pageview_event() -> Column:
    return F.col("event_name") == "pageview"


def _facts(sessionated: DataFrame, *keys: Column | str) -> DataFrame:
    """Event counts per key and session, with the session's duration in seconds.

    The duration follows from the counted rows, so the events are read once.
    """
    counts = sessionated.groupBy(*keys, "session_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_pageview_event()).alias("views"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )
    whole = Window.partitionBy("session_id")
    first, last = F.min("first_seen").over(whole), F.max("last_seen").over(whole)
    return counts.withColumn("duration", F.timestamp_diff("SECOND", first, last))


def _mean_duration() -> Column:
    """Mean over events of their session's duration."""
    return F.sum(F.col("n") * F.col("duration")) / F.sum("n")


def daily_kpis(sessionated: DataFrame) -> DataFrame:
    """Per day: active and registered users, sessions, events, pageviews."""
    moved = sessionated.withColumns(
        {c: ids.packed(F.col(c)) for c in ("session_id", "client_id")}  # only counted
    )
    return (
        _facts(moved, F.to_date("timestamp").alias("date"), "client_id", "user_id")
        .groupBy("date")
        .agg(
            F.count_distinct("client_id").alias("daily_active_users"),
            F.count_distinct("user_id").alias("daily_active_registered_users"),
            F.count_distinct("session_id").alias("total_sessions"),
            F.sum("n").alias("total_events"),
            F.sum("views").alias("pageviews"),
            _mean_duration().alias("avg_session_duration"),
        )
    )


def dau_growth(kpis: DataFrame, as_of: str | Column, days: int = 30) -> DataFrame:
    """Change of daily active users against the row before, in percent.

    The window has no partition: its input is one row per day.
    """
    before = F.lag("daily_active_users").over(Window.orderBy("date"))
    users = F.col("daily_active_users")
    return (
        kpis.filter(F.col("date") >= F.date_sub(_when(as_of).cast("date"), days))
        .select("date", "daily_active_users", before.alias("prev_day_users"))
        .withColumn("growth_pct", (users - F.col("prev_day_users")) / F.col("prev_day_users") * 100)
    )


def duration_buckets(sessions: DataFrame, as_of: str | Column, days: int = 7) -> DataFrame:
    """Sessions by length, with their share."""
    seconds = F.timestamp_diff("SECOND", F.col("start_ts"), F.col("end_ts"))
    bucket = (
        F.when(seconds < 60, "0-1 min")
        .when(seconds < 300, "1-5 min")
        .when(seconds < 900, "5-15 min")
        .when(seconds < 3600, "15-60 min")
        .otherwise("60+ min")
    )
    counts = (
        sessions.filter(since(as_of, days, "start_ts"))
        .groupBy(bucket.alias("duration_bucket"))
        .agg(F.count(F.lit(1)).alias("session_count"))
    )
    everything = Window.partitionBy(F.lit(1))  # over five rows
    share = F.col("session_count") * 100.0 / F.sum("session_count").over(everything)
    return counts.withColumn("percentage", share).orderBy(F.desc("session_count"))


def top_pages(
    sessionated: DataFrame, as_of: str | Column, days: int = 7, limit: int = 20
) -> DataFrame:
    """Most viewed urls."""
    return (
        sessionated.filter(is_pageview_event() & since(as_of, days))
        .groupBy("url", "client_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("url")
        .agg(F.sum("n").alias("pageviews"), F.count("client_id").alias("unique_visitors"))
        .withColumn("avg_views_per_visitor", F.col("pageviews") / F.col("unique_visitors"))
        .orderBy(F.desc("pageviews"), "url")
        .limit(limit)
    )


def geo_traffic(sessionated: DataFrame, as_of: str | Column, days: int = 30) -> DataFrame:
    """Events, users and sessions by country."""
    keys = [F.col(f"location.{c}").alias(c) for c in ("country", "country_code")]
    return (
        sessionated.filter(since(as_of, days) & F.col("location.country").isNotNull())
        .groupBy(*keys, "client_id", "session_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("country", "country_code")
        .agg(
            F.sum("n").alias("events"),
            F.count_distinct("client_id").alias("unique_users"),
            F.count_distinct("session_id").alias("sessions"),
        )
        .orderBy(F.desc("events"))
    )


def freshness(as_of: str | Column, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Latest record of each table and whole hours behind ``as_of``.

    ``tables`` maps a name to a table and its time or date column.
    """
    parts = []
    for name, (table, column) in tables.items():
        latest = table.agg(F.max(column).cast("timestamp").alias("latest_record"))
        parts.append(latest.select(F.lit(name).alias("table_name"), "latest_record"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    behind = F.timestamp_diff("HOUR", F.col("latest_record"), _when(as_of))
    return out.withColumn("hours_behind", behind)


def hourly_events(events: DataFrame) -> DataFrame:
    """Events per hour."""
    hour = F.date_trunc("HOUR", "timestamp").alias("hour_block")
    return (
        events.groupBy(hour)
        .agg(F.count(F.lit(1)).alias("event_count"))
        .select(
            F.to_date("hour_block").alias("date"),
            F.hour("hour_block").alias("hour"),
            "hour_block",
            "event_count",
        )
    )


def client_user_map(events: DataFrame) -> DataFrame:
    """First and last time each user was seen with each client id."""
    return (
        events.filter(F.col("user_id").isNotNull())
        .groupBy("client_id", "user_id")
        .agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    )


def user_activity(sessionated: DataFrame) -> DataFrame:
    """Activity of each (client, user)."""
    return (
        _facts(sessionated, "client_id", "user_id", F.to_date("timestamp").alias("date"))
        .groupBy("client_id", "user_id")
        .agg(
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.count_distinct("date").alias("days_active"),
            F.sum("n").alias("total_events"),
            F.count_distinct("session_id").alias("total_sessions"),
            _mean_duration().alias("avg_session_duration"),
        )
    )


def session_summary(sessionated: DataFrame) -> DataFrame:
    """Per (session, client, user): span, hits, pages and event names.

    ``events`` holds the distinct event names, in order.
    """
    keys = ["session_id", "client_id", "user_id"]
    return (
        sessionated.groupBy(*keys, "url", "event_name")
        .agg(
            F.min("timestamp").alias("first"),
            F.max("timestamp").alias("last"),
            F.count(F.lit(1)).alias("n"),
        )
        .groupBy(*keys)
        .agg(
            F.min("first").alias("session_start"),
            F.max("last").alias("session_end"),
            F.timestamp_diff("SECOND", F.min("first"), F.max("last")).alias("session_duration"),
            F.sum("n").alias("pageviews"),
            F.count_distinct("url").alias("unique_pages"),
            F.sort_array(F.collect_set("event_name")).alias("events"),
        )
    )


def anon_clients(sessionated: DataFrame) -> DataFrame:
    """Activity of each client, over events without a user."""
    return (
        sessionated.filter(F.col("user_id").isNull())
        .groupBy("client_id", "session_id", F.to_date("timestamp").alias("date"))
        .agg(
            F.min("timestamp").alias("first"),
            F.max("timestamp").alias("last"),
            F.count(F.lit(1)).alias("n"),
        )
        .groupBy("client_id")
        .agg(
            F.min("first").alias("first_seen"),
            F.max("last").alias("last_seen"),
            F.count_distinct("date").alias("days_active"),
            F.sum("n").alias("total_events"),
            F.count_distinct("session_id").alias("total_sessions"),
        )
    )


def session_numbers(
    events: DataFrame, key: str = "client_id", gap_minutes: int = 30
) -> DataFrame:
    """Add ``new_session`` and the running ``session_number`` per ``key``.

    A session starts after a pause of more than ``gap_minutes`` whole minutes;
    the first has number 0.  No pause fits into a slice as long as the gap, so
    numbers are a running sum over slices, one row each, joined back.
    """
    sliced = events.withColumn("slice", slice_start(F.col("timestamp"), gap_minutes * 60))
    by_time = Window.partitionBy(key).orderBy("slice")
    opening = F.min(F.struct("timestamp", "event_id")).alias("opening")
    pause = F.timestamp_diff(
        "MINUTE", F.lag("last_ts").over(by_time), F.col("opening.timestamp")
    )
    numbers = (
        sliced.groupBy(F.col(key).alias("_key"), "slice")
        .agg(opening, F.max("timestamp").alias("last_ts"))
        .withColumnRenamed("_key", key)
        .withColumn("opens", F.coalesce(pause > gap_minutes, F.lit(False)).cast("int"))
        .withColumn("session_number", F.sum("opens").over(by_time))
        .select(
            F.col(key).alias("_key"), F.col("slice").alias("_slice"),
            "opening", "opens", "session_number",
        )
    )
    is_opening = F.col("event_id") == F.col("opening.event_id")
    return (
        sliced.join(
            numbers,
            F.col(key).eqNullSafe(F.col("_key")) & (F.col("slice") == F.col("_slice")),
        )
        .withColumn("new_session", F.when(is_opening, F.col("opens")).otherwise(0))
        .drop("_key", "_slice", "slice", "opening", "opens")
    )


def daily_event_names(events: DataFrame, as_of: str | Column, days: int = 7) -> DataFrame:
    """Events and visitors per day and event name."""
    after = F.col("timestamp") > _when(as_of) - F.make_dt_interval(F.lit(days))
    return (
        events.filter(after)
        .groupBy(F.to_date("timestamp").alias("day"), "event_name", "hash")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("day", "event_name")
        .agg(F.sum("n").alias("events"), F.count("hash").alias("unique_visitors"))
        .orderBy(F.desc("day"), F.desc("events"))
    )


def recent_events(
    events: DataFrame,
    limit: int = 10,
    event_name: str | None = None,
    user_agent: str | None = None,
) -> DataFrame:
    """Latest events, optionally of one name and user agent."""
    for column, wanted in (("event_name", event_name), ("user_agent", user_agent)):
        if wanted is not None:
            events = events.filter(F.col(column) == wanted)
    return events.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(limit)


def _periods(events: DataFrame, key: str, period: Column, name: str) -> DataFrame:
    """Distinct (key, period) with the key's first one; few rows per key."""
    return (
        events.filter(F.col(key).isNotNull())
        .select(key, period.alias(name))
        .distinct()
        .withColumn(f"first_{name}", F.min(name).over(Window.partitionBy(key)))
    )


def returning_visitors(events: DataFrame, key: str = "client_id") -> DataFrame:
    """Per key and day: was it seen on an earlier day?"""
    days = _periods(events, key, F.to_date("timestamp"), "date")
    return days.withColumn("is_returning", F.col("date") > F.col("first_date"))


def retention(events: DataFrame, key: str = "client_id") -> DataFrame:
    """Clients still active, by week first seen and weeks since."""
    weeks = _periods(events, key, F.to_date(F.date_trunc("WEEK", "timestamp")), "week")
    offset = (F.date_diff("week", "first_week") / 7).cast("int")
    return weeks.groupBy(F.col("first_week").alias("cohort"), offset.alias("week_offset")).agg(
        F.count(F.lit(1)).alias("clients")
    )


def _next_hits(hits: DataFrame, reached: DataFrame, key: str) -> DataFrame:
    """First hit of each key at or after ``reached_at``.

    Hits of the same hour are compared one by one, joined by key and hour;
    later hours count with their first hit only.  So no key's hits meet in one
    task.
    """
    hour = slice_start(F.col("reached_at"), 3600)
    same = (
        hits.join(reached.withColumn("slice", hour), [key, "slice"])
        .filter(F.col("timestamp") >= F.col("reached_at"))
        .select(key, "timestamp")
    )
    later = (
        hits.groupBy(key, "slice")
        .agg(F.min("timestamp").alias("timestamp"))
        .join(reached.withColumn("hour", hour), key)
        .filter(F.col("slice") > F.col("hour"))
        .select(key, "timestamp")
    )
    return same.unionByName(later)


def funnel(events: DataFrame, steps: Sequence[str], key: str = "client_id") -> DataFrame:
    """Clients that reach each step, in order.

    A step counts at its first time at or after the step before it.  Each
    step's clients are written down, as the next step reads them twice.
    """
    seen = events.filter(F.col(key).isNotNull() & F.col("event_name").isin(*steps)).select(
        key,
        "event_name",
        "timestamp",
        slice_start(F.col("timestamp"), 3600).alias("slice"),
    )
    reached = None
    out = None
    for number, step in enumerate(steps, start=1):
        hits = seen.filter(F.col("event_name") == step)
        if reached is not None:
            hits = _next_hits(hits, reached, key)
        first = hits.groupBy(key).agg(F.min("timestamp").alias("reached_at"))
        reached = stage(first, f"funnel_{number}")
        row = reached.agg(F.count(F.lit(1)).alias("clients")).select(
            F.lit(number).alias("step"), F.lit(step).alias("event_name"), "clients"
        )
        out = row if out is None else out.unionByName(row)
    return out


def burst_flags(
    events: DataFrame, limit: int = 100, window: str = "1 minute", key: str = "hash"
) -> DataFrame:
    """Keys with more than ``limit`` events in a tumbling window."""
    return (
        events.groupBy(F.window("timestamp", window).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("events"))
        .filter(F.col("events") > limit)
        .select(
            key,
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "events",
        )
    )
