"""Unique ids for raw events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.ids import digest_id

#: Copies that one step of the numbering makes of a row.
STEP = 10_000
COPY = "_copy"
MICROSECONDS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def with_event_ids(
    events: DataFrame, position: str | None = None, name: str = "event_id"
) -> DataFrame:
    """Add an id digested from visitor hash, time and what tells ties apart.

    That is ``position``, a column that differs between rows, or else the row's
    content and a number among equal copies.  Copies are counted, which combines
    on the map side, and dealt out again in steps, so no group of ties comes
    together in one task's memory and no row is sorted.  Ids do not depend on
    how the rows lie.
    """
    start = [F.col("hash"), F.unix_micros("timestamp")]
    if position is not None:
        return events.withColumn(name, digest_id(*start, F.col(position)))
    content = F.sha2(F.to_json(F.struct(*events.columns)), 256)
    return _numbered(events).withColumn(name, digest_id(*start, content, F.col(COPY))).drop(COPY)


def with_batch_ids(events: DataFrame, batch: str, name: str = "event_id") -> DataFrame:
    """Add an id digested from the ``batch``'s name, the row's content and its copy number.

    The rows of a batch get the same ids however often and in whatever order it is
    processed; equal rows differ by their number, equal rows of two batches by the name.
    No id is NULL.
    """
    shown = {"timestampFormat": MICROSECONDS, "timeZone": "UTC", "ignoreNullFields": "false"}
    content = F.sha2(F.to_json(F.struct(*events.columns), shown), 256)
    digest = digest_id(F.lit(batch), F.lit("|"), content, F.lit("|"), F.col(COPY))
    return _numbered(events).withColumn(name, digest).drop(COPY)


def _numbered(events: DataFrame) -> DataFrame:
    """The rows, equal ones numbered from 0 in ``COPY``: counted and dealt out again."""
    columns = events.columns
    counted = events.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    steps = F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / STEP))
    stepped = counted.select(*columns, "_copies", F.explode(steps).alias("_step"))
    done = F.col("_step") * STEP
    rest = F.sequence(done, F.least(done + STEP, F.col("_copies")) - 1)
    return stepped.select(*columns, F.explode(rest).alias(COPY))
