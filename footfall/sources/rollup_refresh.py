"""Clients and users brought up to date from what arrived, without their history.

Three tables of mergeable states are kept, each by day and, merged, by month:

- ``clients``: of each client, by ``real`` (the session has a client id of its own);
- ``seen``: of each user in each client's sessions, by ``real`` and by ``named`` (one of
  the user's events in the session came with a real client id);
- ``links``: each (client, user) that an event with a real client id names.

A first or last session cannot be subtracted, so a changed day is not taken off a total:
its own states are replaced, and those of its month merged again from the month's days.
The roll-ups merge months.  No refresh reads sessions or events of other days, and a
repeated or interrupted one, run again, changes nothing.  Before the first refresh that
finds sessions there are no tables to read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.config import DEFAULT, Config
from footfall.plans import rollup
from footfall.sources.events import PARTITION
from footfall.sources.incremental import on_days, replace_partitions, session_days, touched_days
from footfall.sources.staging import stage, staging_run

MONTH = "event_month"
CLIENT = ["client_id", "real"]
SEEN = ["client_id", "user_id", "real", "named"]
LINK = ["client_id", "user_id"]


def client_states(sessions: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A state of each client and day, by ``real``."""
    rows = sessions.withColumn("real", ~F.col("no_client_id"))
    return rollup.states(rows, [*CLIENT, PARTITION], cfg)


def seen_states(sessionated: DataFrame, sessions: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A state of each client, user and day, over the sessions the user is seen in."""
    users = sessionated.filter(F.col("user_id").isNotNull())
    users = users.groupBy("session_id", "user_id").agg((~F.min("no_client_id")).alias("named"))
    rows = sessions.withColumn("real", ~F.col("no_client_id")).join(users, "session_id")
    return rollup.states(rows, [*SEEN, PARTITION], cfg)


def link_days(sessionated: DataFrame) -> DataFrame:
    """The distinct (client, user) of each day's events with a real client id."""
    named = sessionated.filter(~F.col("no_client_id") & F.col("user_id").isNotNull())
    return named.select(*LINK, PARTITION).distinct()


def refresh_rollups(
    sessionated: DataFrame,
    sessions: DataFrame,
    path: str,
    arrived: DataFrame,
    cfg: Config = DEFAULT,
    margin_days: int = 1,
) -> None:
    """Replace the states of the days that ``arrived`` can change, and those of their months.

    ``sessionated`` and ``sessions`` are the tables by day, refreshed before with the same
    ``arrived`` and ``margin_days``.
    """
    days = session_days(arrived, cfg, margin_days)
    if not days:
        return
    near = touched_days(arrived, margin_days)
    around = session_days(arrived, cfg, 2 * margin_days)
    visits, events = on_days(sessions, days), on_days(sessionated, around)

    def states_by(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
        return lambda days: rollup.merged(days, [*keys, MONTH], cfg)

    with staging_run(sessions.sparkSession):
        _replace(client_states(visits, cfg), f"{path}/clients", days, states_by(CLIENT))
        _replace(seen_states(events, visits, cfg), f"{path}/seen", days, states_by(SEEN))
        links = link_days(on_days(sessionated, near))
        _replace(links, f"{path}/links", near, lambda days: days.select(*LINK, MONTH).distinct())


def _replace(
    rows: DataFrame, path: str, days: Sequence[date], merge: Callable[[DataFrame], DataFrame]
) -> None:
    replace_partitions(rows, f"{path}/days", PARTITION, days)
    months = sorted({day.replace(day=1) for day in days})
    kept = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/days")
    month = F.trunc(PARTITION, "month")
    kept = kept.filter(month.isin(months)).withColumn(MONTH, month).drop(PARTITION)
    replace_partitions(merge(kept), f"{path}/months", MONTH, months)


def _months(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}/months")


def refreshed_clients(spark: SparkSession, path: str, cfg: Config = DEFAULT) -> DataFrame:
    """``rollup.clients`` from the months' states."""
    found = rollup.merged(_months(spark, path, "clients"), ["client_id"], cfg)
    return rollup.shown_states(found, ["client_id"], cfg)


def refreshed_users(spark: SparkSession, path: str, cfg: Config = DEFAULT) -> DataFrame:
    """``rollup.users`` from the months' states.

    A user named with a client owns all sessions of the client that are ``real``.  Other
    sessions the user is seen in count by themselves: those without a real client id,
    unless owned that way, and those of clients that have no real session.
    """
    real = rollup.merged(_months(spark, path, "clients").filter("real"), ["client_id"], cfg)
    real = stage(real, "real_clients")
    links = stage(_months(spark, path, "links").select(*LINK).distinct(), "client_links")
    seen = _months(spark, path, "seen").drop(MONTH)
    owned = seen.filter("real").join(links, LINK, "left_anti").unionByName(seen.filter("NOT real"))
    alone = owned.filter("NOT named").unionByName(
        seen.filter("named").join(real.select("client_id"), "client_id", "left_anti")
    )
    parts = real.join(links, "client_id").drop("client_id").unionByName(alone.drop(*CLIENT, "named"))
    return rollup.shown_states(rollup.merged(parts, ["user_id"], cfg), ["user_id"], cfg)
