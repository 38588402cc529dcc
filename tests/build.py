"""Small tables for tests."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from footfall import schema

START = datetime(2024, 3, 1, 12, 0, 0)
EVENTS = T.StructType([T.StructField("event_id", T.LongType()), *schema.EVENTS.fields])
DEVICE = dict.fromkeys(schema.DEVICE.names)
LOCATION = dict.fromkeys(schema.LOCATION.names)


def at(minutes: float = 0, **more) -> datetime:
    return START + timedelta(minutes=minutes, **more)


def events(spark: SparkSession, *rows: dict) -> DataFrame:
    """Events with defaults; ids follow the order given."""
    full = []
    for number, row in enumerate(rows):
        base = dict.fromkeys(schema.EVENTS.names)
        base.update(
            event_id=number,
            timestamp=START,
            event_type="event",
            event_name="pageview",
            parameters="{}",
            user_agent="Mozilla/5.0 Firefox/120",
            url="https://example.com/",
            hash="h",
            device=DEVICE,
            location=LOCATION,
        )
        base.update(row)
        full.append(base)
    return spark.createDataFrame(full, EVENTS)


def column(df: DataFrame, name: str, by: str = "event_id") -> list:
    return [row[name] for row in df.select(by, name).orderBy(by).collect()]
