"""Data checks: each returns the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_null(table: DataFrame, column: str) -> DataFrame:
    return table.filter(F.col(column).isNull())


def unique(table: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their count."""
    return (
        table.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )


def non_negative_duration(sessions: DataFrame) -> DataFrame:
    seconds = F.timestamp_diff("SECOND", F.col("start_ts"), F.col("end_ts"))
    return sessions.withColumn("session_duration", seconds).filter("session_duration < 0")


def null_counts(table: DataFrame) -> DataFrame:
    """Per column: rows without a value.  One pass over the table."""
    counts = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in table.columns])
    return counts.unpivot([], table.columns, "column_name", "nulls")


def failures(checks: dict[str, DataFrame]) -> DataFrame:
    """Offending rows per named check."""
    out = None
    for name, rows in checks.items():
        row = rows.agg(F.count(F.lit(1)).alias("failures")).select(
            F.lit(name).alias("check_name"), "failures"
        )
        out = row if out is None else out.unionByName(row)
    return out


def standard_checks(sessionated: DataFrame, sessions: DataFrame) -> dict[str, DataFrame]:
    """The checks every build should pass."""
    return {
        "events_sessionated.client_id not null": not_null(sessionated, "client_id"),
        "events_sessionated.timestamp not null": not_null(sessionated, "timestamp"),
        "events_sessionated.session_id not null": not_null(sessionated, "session_id"),
        "events_sessionated.event_id unique": unique(sessionated, "event_id"),
        "sessions.session_id unique": unique(sessions, "session_id"),
        "sessions.duration not negative": non_negative_duration(sessions),
    }
