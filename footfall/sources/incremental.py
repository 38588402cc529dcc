"""Refreshing tables without reading all history.

A refresh is told what arrived and computes exactly the days again that have new
rows, however late these are.  Days are replaced whole, so a refresh that is
repeated or interrupted changes nothing and duplicates nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from footfall.config import DEFAULT, Config
from footfall.plans import reports
from footfall.plans import sessions as session_models
from footfall.plans.sessionated import events_sessionated
from footfall.sources.events import PARTITION, overwrite_days
from footfall.sources.staging import remove, staging_run

KEYS = ["client_id", "user_id"]


def touched_days(arrived: DataFrame, margin: int = 0) -> list[date]:
    """The days of the rows that arrived, and ``margin`` days on either side.

    One entry per day is all that reaches the driver.
    """
    days = arrived.select(F.to_date("timestamp").alias("day")).distinct()
    found = {row.day for row in days.filter("day IS NOT NULL").collect()}
    around = [timedelta(days=n) for n in range(-margin, margin + 1)]
    return sorted({day + shift for day in found for shift in around})


def on_days(rows: DataFrame, days: Sequence[date]) -> DataFrame:
    """Rows of some days; by the partition column, where there is one."""
    day: Column = F.col(PARTITION) if PARTITION in rows.columns else F.to_date("timestamp")
    return rows.filter(day.isin(list(days)))


def replace_partitions(rows: DataFrame, path: str, column: str, values: Sequence[date]) -> None:
    """Make the partitions ``values`` of ``path`` hold just ``rows``; one without rows goes.

    The write itself observes which have rows: one flag per partition is all that reaches
    the driver.
    """
    seen = Observation()
    full = [F.max(F.col(column) == F.lit(value)).alias(str(value)) for value in values]
    overwrite_days(rows.filter(F.col(column).isin(list(values))).observe(seen, *full), path, column)
    for value in values:
        if not seen.get[str(value)]:
            remove(rows.sparkSession, f"{path}/{column}={value}")


def session_days(arrived: DataFrame, cfg: Config = DEFAULT, margin: int = 1) -> list[date]:
    """The days of sessions that ``arrived`` can change: sources are lent for the lookback."""
    ahead = range(cfg.client_lookback_days + 1)
    return sorted({day + timedelta(days=n) for day in touched_days(arrived, margin) for n in ahead})


def daily_activity(events: DataFrame) -> DataFrame:
    """Per day and (client, user): first and last time seen."""
    return events.groupBy(F.to_date("timestamp").alias("date"), *KEYS).agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")
    )


def users_from_days(days: DataFrame) -> DataFrame:
    """Per (client, user): first and last time seen, days active."""
    return days.groupBy(*KEYS).agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.count(F.lit(1)).alias("days_active"),
    )


def refresh_days(events: DataFrame, path: str, arrived: DataFrame | None = None) -> None:
    """Bring the daily table at ``path`` up to date with ``events``.

    ``arrived`` holds the new rows among ``events``; all of them count as new
    without it.
    """
    if arrived is not None:
        events = on_days(events, touched_days(arrived))
    overwrite_days(daily_activity(events), path, "date")


def refresh_sessionated(
    events: DataFrame,
    path: str,
    arrived: DataFrame,
    cfg: Config = DEFAULT,
    margin_days: int = 1,
) -> None:
    """Compute again the sessions of the days that ``arrived`` has events for.

    ``events`` is the raw table with ids.  A block can reach over midnight, so
    ``margin_days`` on either side of each day are replaced as well and as many
    more are read.  The visitor hash changes daily, so one day is enough unless
    hits bring hashes of their own.
    """
    replaced = touched_days(arrived, margin_days)
    if not replaced:
        return
    read = on_days(events, touched_days(arrived, 2 * margin_days))
    with staging_run(events.sparkSession):
        rows = events_sessionated(read.drop(PARTITION), cfg, parameters=False, days=replaced)
        overwrite_days(rows, path, is_sized=True)


def refresh_daily_kpis(
    sessionated: DataFrame, path: str, arrived: DataFrame, margin_days: int = 1
) -> None:
    """Compute again the report rows of the days that ``arrived`` has events for.

    Sessions reach over midnight, so neighbouring days change with a day.
    """
    replaced = touched_days(arrived, margin_days)
    if replaced:
        rows = reports.daily_kpis(on_days(sessionated, touched_days(arrived, 2 * margin_days)))
        overwrite_days(rows.filter(F.col("date").isin(replaced)), path, "date")


def refresh_sessions(
    sessionated: DataFrame,
    path: str,
    arrived: DataFrame,
    cfg: Config = DEFAULT,
    margin_days: int = 1,
) -> None:
    """Compute again the sessions that start on days that what arrived can change.

    A session borrows its source from up to ``client_lookback_days`` before, so as
    many days after a new event are computed again, and as many before are read.
    """
    replaced = session_days(arrived, cfg, margin_days)
    if not replaced:
        return
    back = range(-cfg.client_lookback_days - margin_days, margin_days + 1)
    read = sorted({day + timedelta(days=n) for day in replaced for n in back})
    with staging_run(sessionated.sparkSession):
        found = session_models.sessions(on_days(sessionated, read), cfg)
        rows = found.withColumn(PARTITION, F.to_date("start_ts"))
        replace_partitions(rows, path, PARTITION, replaced)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
