"""The raw events table: Parquet, one partition per UTC day."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall import schema
from footfall.functions import ids
from footfall.operators.event_ids import with_batch_ids

PARTITION = "event_date"
#: Which write a row came with; a repeated write replaces its own rows only.
BATCH = "ingest_batch"
ID = "event_id"
#: Hex and base64 digests take little more room in it than the bytes they stand for.
CODEC = "zstd"
#: Digests among the columns, which move packed.
MOVED = (ID, "hash", "client_id", "block_id", "session_id")


def stored_schema() -> T.StructType:
    """Columns of the table as written: ids are given once, when a row is written."""
    added = [
        T.StructField(ID, T.StringType()),
        T.StructField(PARTITION, T.DateType()),
        T.StructField(BATCH, T.StringType()),
    ]
    return T.StructType([*schema.EVENTS.fields, *added])


def read_events(
    spark: SparkSession, path: str, since: date | None = None, until: date | None = None
) -> DataFrame:
    """Events, from ``since`` to ``until`` (both included) if given.

    The dates are compared with the partition column, so other days are not
    listed for reading.
    """
    out = spark.read.schema(stored_schema()).parquet(path).drop(BATCH)
    if since is not None:
        out = out.filter(F.col(PARTITION) >= F.lit(since))
    if until is not None:
        out = out.filter(F.col(PARTITION) <= F.lit(until))
    return out


def with_day(events: DataFrame) -> DataFrame:
    return events.withColumn(PARTITION, F.to_date("timestamp"))


def sized(table: DataFrame, column: str = PARTITION) -> DataFrame:
    """Rows of one day together, in files of even size.

    The adaptive rebalance splits large days and joins small ones, so neither a
    big day nor a hot visitor ends up in one task.  Ids move packed.
    """
    names = [n for n, kind in table.dtypes if n in MOVED and kind == "string"]
    beside = "hash" in names and "client_id" in names
    client, visitor = F.col("client_id"), F.col("hash")
    packed = {n: ids.packed(F.col(n)) for n in names}
    unpacked = {n: ids.unpacked(F.col(n)) for n in names}
    if beside:
        packed["client_id"] = ids.packed_beside(client, visitor)
        unpacked["client_id"] = ids.unpacked_beside(client, unpacked["hash"])
    return table.withColumns(packed).hint("rebalance", column).withColumns(unpacked)


def append_events(events: DataFrame, path: str, batch: str | None = None) -> None:
    """Append processed events, with ids of their own.

    A failed write raises and leaves no rows.  Ids follow from the batch's name and the
    rows' content, unless the rows bring their own.  A write with the name of an earlier
    ``batch`` replaces that batch in the days it has rows for, so a repeated one changes
    nothing: what was derived from the first still joins.  A visitor's rows lie together in
    a file, so they take less room there and where they are moved on.
    """
    batch = batch or uuid.uuid4().hex
    given = ID in events.columns
    rows = events.withColumn(ID, F.col(ID).cast("string")) if given else with_batch_ids(events, batch, ID)
    rows = with_day(rows)
    (
        sized(rows.withColumn(BATCH, F.lit(batch)), PARTITION)
        .sortWithinPartitions(PARTITION, BATCH, "hash", "timestamp")
        .write.mode("overwrite")
        .option("compression", CODEC)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PARTITION, BATCH)
        .parquet(path)
    )


def overwrite_days(
    table: DataFrame, path: str, column: str = PARTITION, is_sized: bool = False
) -> None:
    """Replace the days that occur in ``table``; other days stay.

    ``is_sized``: its rows lie together by day already.
    """
    (
        (table if is_sized else sized(table, column))
        .write.mode("overwrite")
        .option("compression", CODEC)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(column)
        .parquet(path)
    )


def retained(events: DataFrame, as_of: Column, months: int = 14) -> DataFrame:
    """Events within the retention period, by whole days."""
    day = F.col(PARTITION) if PARTITION in events.columns else F.to_date("timestamp")
    return events.filter(day >= F.add_months(as_of, -months))


def expired_days(spark: SparkSession, table: str, as_of: date, months: int = 14) -> list[date]:
    """Partitions of a catalog table that are past retention.

    Only the catalog's list of days is read, one entry per day.
    """
    named = F.regexp_extract("partition", rf"{PARTITION}=(\d{{4}}-\d{{2}}-\d{{2}})", 1)
    days = spark.sql(f"SHOW PARTITIONS {table}").select(F.try_to_date(named).alias("day"))
    old = days.filter(F.col("day") < F.add_months(F.lit(as_of), -months))
    return [row.day for row in old.orderBy("day").collect()]


def purge_expired(spark: SparkSession, table: str, as_of: date, months: int = 14) -> list[date]:
    """Drop partitions past retention; returns the days dropped."""
    days = expired_days(spark, table, as_of, months)
    for day in days:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({PARTITION} = DATE'{day}')")
    return days
