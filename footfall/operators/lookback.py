"""Borrowing a source from an earlier session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.config import DEFAULT, Config
from footfall.functions import ids
from footfall.operators import carry


def with_donor(
    rows: DataFrame, cfg: Config = DEFAULT, lenders: DataFrame | None = None
) -> DataFrame:
    """Add ``donor``, start and source of the client's latest external session strictly before.

    The sessions move once, with packed ids, to eight hours of their client; the clock
    bounds every window, so a client may have any share of them.  ``rows`` should be a
    written table.  ``lenders`` are the sessions that may lend, ``rows`` themselves by default.
    """
    lenders = rows if lenders is None else lenders
    us = F.unix_micros("start_ts")
    donor, rank = F.struct("start_ts", "utm", "clid"), F.struct("session_id", "hash")
    client, visitor = F.col("client_id"), F.col("hash")
    donors = lenders.filter("is_external").select(
        ids.packed(client).alias("client_id"), us.alias("us"), rank.alias("rank"), donor.alias("value")
    )
    # strictly before an instant is at or before the microsecond ahead of it
    asked = rows.withColumns(
        {
            "client_id": ids.packed(client),
            "hash": ids.packed_beside(visitor, client),
            "session_id": ids.packed(F.col("session_id")),
            "us": us - 1,
        }
    )
    found = carry.in_force(asked, donors, ["client_id"], cfg.lookback_seconds).withColumns(
        {
            "client_id": ids.unpacked(client),
            "hash": ids.unpacked_beside(visitor, ids.unpacked(client)),
            "session_id": ids.unpacked(F.col("session_id")),
        }
    )
    return found.select(*rows.columns, F.col("value").alias("donor"))


def attribute(
    rows: DataFrame, cfg: Config = DEFAULT, lenders: DataFrame | None = None
) -> DataFrame:
    """Give sessions without an external source the donor's ``utm``, ``clid``.

    The donor counts if it is less than the lookback old: days for clients
    with a real id, hours for those known by visitor hash only.  Checking the
    latest donor suffices, as any other is older still.  Sessions that take none do
    not move to their donors.
    """
    age = F.unix_micros("start_ts") - F.unix_micros("donor.start_ts")
    days = cfg.client_lookback_days * 86_400_000_000
    hours = cfg.hash_lookback_hours * 3_600_000_000
    near = ((F.col("hash") != F.col("client_id")) & (age < days)) | (age < hours)
    takes = F.coalesce(~F.col("is_external"), F.lit(False))
    placed = F.col("client_id").isNotNull() & F.col("start_ts").isNotNull()
    found = with_donor(rows.filter(takes), cfg, rows if lenders is None else lenders)
    found = found.withColumn("donor", F.when(near, F.col("donor")))
    none = F.lit(None).cast(found.schema["donor"].dataType)
    return (
        found.unionByName(rows.filter(~takes & placed).withColumn("donor", none))
        .withColumns(
            {
                "utm": F.coalesce("donor.utm", "utm"),
                "clid": F.coalesce("donor.clid", "clid"),
                "donor_start_ts": F.col("donor.start_ts"),
            }
        )
        .drop("donor")
    )
