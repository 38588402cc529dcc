"""Sessions rolled up by client or user.

What a roll-up says about a key in fixed width (span, first and last source, counts) is a
mergeable state: states of hours merge into a client's, states of clients into a user's.
What grows with a key's sessions (paths, source lists) comes as segments of bounded size,
one row each; the whole path in one row only if asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.config import DEFAULT, Config
from footfall.functions import ids
from footfall.operators.timeline import slice_start
from footfall.sources.staging import stage

PATH_SEPARATOR = " > "
#: Sessions of a key in one segment of its path.
SEGMENT = 1000
ORDER = ("start_ts", "session_id")


def touchpoint() -> Column:
    """'source/medium:campaign' of an external session, else NULL."""
    utm = F.col("utm")
    blank = F.lit("")
    text = F.concat(
        F.coalesce(utm["source"], blank),
        F.lit("/"),
        F.coalesce(utm["medium"], blank),
        F.lit(":"),
        F.coalesce(utm["campaign"], blank),
    )
    return F.when(F.col("is_external"), text)


def touchpoints(sessions: DataFrame, key: str = "client_id") -> DataFrame:
    """One row per external session: the long form of the path text."""
    return sessions.filter("is_external").select(key, *ORDER, touchpoint().alias("touchpoint"))


# --- States of fixed width -----------------------------------------------------


def states(sessions: DataFrame, keys: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """One mergeable state per ``keys``."""
    row = F.struct(*ORDER, "utm")
    known = F.col("is_external") & F.col("utm.source").isNotNull()
    return sessions.groupBy(*keys).agg(
        F.min("start_ts").alias("start_ts"),
        F.max("end_ts").alias("end_ts"),
        F.min(row).alias("first"),
        F.max(row).alias("last"),
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(known).alias("ext_sources"),
        *[F.sum(m.name).alias(m.name) for m in cfg.session_metrics],
        F.min("no_client_id").alias("no_client_id"),
    )


def merged(parts: DataFrame, keys: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """States of parts of the sessions into states per ``keys``."""
    counts = ["sessions", "ext_sources", *[m.name for m in cfg.session_metrics]]
    return parts.groupBy(*keys).agg(
        F.min("start_ts").alias("start_ts"),
        F.max("end_ts").alias("end_ts"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        *[F.sum(c).alias(c) for c in counts],
        F.min("no_client_id").alias("no_client_id"),
    )


def shown_states(found: DataFrame, keys: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """The columns of a roll-up from the states of its keys."""
    metrics = [
        (F.when(F.col(m.name) > 0, 1).otherwise(0).cast("long") if m.once else F.col(m.name)).alias(m.name)
        for m in cfg.session_metrics
    ]
    return found.select(
        *keys,
        F.col("start_ts").alias("first_session_ts"),
        F.col("end_ts").alias("last_session_ts"),
        F.col("first")["utm"].alias("first_utm"),
        F.col("last")["utm"].alias("last_utm"),
        "sessions",
        "ext_sources",
        *metrics,
        "no_client_id",
    )


def sliced_states(sessions: DataFrame, key: str, cfg: Config = DEFAULT) -> DataFrame:
    """A state for each key, by way of the key's hours: a hot key is spread over these."""
    hour = slice_start(F.col("start_ts"), cfg.session_bin_seconds)
    return merged(states(sessions.withColumn("slice", hour), [key, "slice"], cfg), [key], cfg)


# --- Paths ---------------------------------------------------------------------


def positioned(rows: DataFrame, key: str, cfg: Config = DEFAULT) -> DataFrame:
    """Add ``position``: the row's number, from 0, within its key by start.

    A prefix sum on two levels: the counts of a key's hours are added up over its hours,
    and rows are numbered within the hour.  No window sees more rows of a key than those
    of one hour, or than there are hours.  ``rows`` is read twice: a written table.
    """
    rows = rows.withColumn("slice", slice_start(F.col("start_ts"), cfg.session_bin_seconds))
    earlier = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(key, "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(key, "slice").orderBy(*ORDER))
    return (
        rows.join(counts.select(key, "slice", before.alias("before")), [key, "slice"])
        .withColumn("position", F.col("before") + inside - 1)
        .drop("slice", "before")
    )


def _segments(rows: DataFrame, key: str, size: int, *values: str, cfg: Config) -> DataFrame:
    """``steps`` (structs in order) of each key's segments of up to ``size`` rows."""
    placed = positioned(stage(rows.select(key, *ORDER, *values), "path_rows"), key, cfg)
    segment = F.floor(F.col("position") / size)
    row = F.struct("position", "start_ts", *values)
    return placed.groupBy(key, segment.alias("segment")).agg(F.array_sort(F.collect_list(row)).alias("steps"))


def touchpoint_segments(
    sessions: DataFrame, key: str = "client_id", size: int = SEGMENT, cfg: Config = DEFAULT
) -> DataFrame:
    """The path of each key in segments: key, segment (from 0), sessions, path.

    A row has at most ``size`` external sessions, however many a key has.
    """
    found = _segments(touchpoints(sessions, key), key, size, "touchpoint", cfg=cfg)
    texts = F.transform("steps", lambda s: s["touchpoint"])
    return found.select(
        key,
        "segment",
        F.size("steps").cast("long").alias("sessions"),
        F.array_join(texts, PATH_SEPARATOR).alias("path"),
    )


def source_segments(
    sessions: DataFrame, key: str = "client_id", size: int = SEGMENT, cfg: Config = DEFAULT
) -> DataFrame:
    """The known external sources of each key in segments: key, segment, steps.

    ``steps`` are up to ``size`` structs of position, start_ts and utm, in order.
    """
    known = sessions.filter(F.col("is_external") & F.col("utm.source").isNotNull())
    return _segments(known, key, size, "utm", cfg=cfg)


def with_paths(rolled: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Add ``touchpoints``, the whole path of a key, which then has to fit one row."""
    parts = F.array_sort(F.collect_list(F.struct("segment", "path")))
    whole = F.array_join(F.transform(parts, lambda p: p["path"]), PATH_SEPARATOR)
    return rolled.join(segments.groupBy(key).agg(whole.alias("touchpoints")), key, "left")


# --- Clients and users ---------------------------------------------------------


def roll_up(sessions: DataFrame, key: str, cfg: Config = DEFAULT) -> DataFrame:
    """Per ``key``: span, first and last utm, counts and metrics."""
    return shown_states(sliced_states(sessions, key, cfg), [key], cfg)


def clients(sessions: DataFrame, cfg: Config = DEFAULT, paths: bool = False) -> DataFrame:
    """All sessions of each client; with ``paths`` the whole path as text."""
    rolled = roll_up(sessions, "client_id", cfg)
    return with_paths(rolled, touchpoint_segments(sessions, cfg=cfg), "client_id") if paths else rolled


@dataclass(frozen=True)
class Owners:
    """Whose sessions are whose, without a row for each session and user.

    ``by_client`` (client_id, user_id): the user owns all sessions of the client that have
    a real client id.  ``by_session`` (session_id, user_id): what that does not cover.
    """

    by_client: DataFrame
    by_session: DataFrame


def owners(sessionated: DataFrame, sessions: DataFrame) -> Owners:
    """A user seen in a session of a client with a real id owns all the client's sessions.

    A session without such a client belongs to the users seen in it.  The two parts do not
    overlap.  Both tables are read more than once: written ones.
    """
    session, client = F.col("session_id"), F.col("client_id")
    moved = {"session_id": ids.packed(session), "client_id": ids.packed(client)}
    seen = sessionated.withColumns(moved).groupBy("session_id", "client_id", "user_id").agg(
        F.min("no_client_id").alias("no_client_id")
    )
    seen = stage(seen, "seen")
    real = seen.filter(~F.col("no_client_id"))
    targets = sessions.filter(~F.col("no_client_id")).withColumns(moved).select("client_id", "session_id")
    by_client = real.select("client_id", "user_id").distinct()
    alone = real.join(targets, "client_id", "left_anti").unionByName(seen.filter("no_client_id"))
    alone = alone.select("session_id", "user_id").distinct()
    placed = alone.join(targets, "session_id", "left")
    pairs = by_client.select(F.col("client_id").alias("c"), F.col("user_id").alias("u"))
    same = (F.col("client_id") == F.col("c")) & F.col("user_id").eqNullSafe(F.col("u"))
    by_session = placed.join(pairs, same, "left_anti").select("session_id", "user_id")
    by_client = by_client.withColumn("client_id", ids.unpacked(client))
    by_session = by_session.withColumn("session_id", ids.unpacked(session))
    return Owners(stage(by_client, "owners_by_client"), stage(by_session, "owners_by_session"))


def owned(rows: DataFrame, whose: Owners) -> DataFrame:
    """``rows`` of sessions (client_id, session_id, no_client_id and more) once per user."""
    real = rows.filter(~F.col("no_client_id")).join(whose.by_client, "client_id")
    return real.unionByName(rows.join(whose.by_session, "session_id"))


def user_map(whose: Owners, sessions: DataFrame) -> DataFrame:
    """Distinct (session_id, user_id): as many rows as sessions have users."""
    targets = sessions.filter(~F.col("no_client_id")).select("client_id", "session_id")
    spread = targets.join(whose.by_client, "client_id").select("session_id", "user_id")
    return spread.unionByName(whose.by_session)


def users(sessions: DataFrame, whose: Owners, cfg: Config = DEFAULT, paths: bool = False) -> DataFrame:
    """All sessions mapped to each user.

    Clients are rolled up first, so a user meets one state of each client, not all its
    sessions.  A session with several users counts for each of them, so session counts do
    not add up over users.  With ``paths`` the whole path comes as text.
    """
    known = F.col("user_id").isNotNull()
    named = Owners(whose.by_client.filter(known), whose.by_session.filter(known))
    real = sliced_states(sessions.filter(~F.col("no_client_id")), "client_id", cfg)
    real = real.join(named.by_client, "client_id").drop("client_id")
    alone = sessions.join(named.by_session, "session_id")
    found = real.unionByName(sliced_states(alone, "user_id", cfg))
    rolled = shown_states(merged(found, ["user_id"], cfg), ["user_id"], cfg)
    return with_paths(rolled, user_touchpoints(sessions, named, cfg=cfg), "user_id") if paths else rolled


def user_touchpoints(
    sessions: DataFrame, whose: Owners, size: int = SEGMENT, cfg: Config = DEFAULT
) -> DataFrame:
    """The path of each user in segments, as ``touchpoint_segments``."""
    external = sessions.filter("is_external")
    return touchpoint_segments(owned(external, whose), "user_id", size, cfg)


def user_sources(
    sessions: DataFrame, whose: Owners, size: int = SEGMENT, cfg: Config = DEFAULT
) -> DataFrame:
    """The known external sources of each user in segments, as ``source_segments``."""
    external = sessions.filter("is_external")
    return source_segments(owned(external, whose), "user_id", size, cfg)
