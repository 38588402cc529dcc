"""Small tables joined to hits: salts and locations."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import schema
from footfall.functions import network
from footfall.sources.once import file_system, names, put_once
from footfall.sources.staging import stage

SALT_FILE = ".salt.parquet"
SALT_DAY = re.compile(r"\d{4}-\d{2}-\d{2}" + re.escape(SALT_FILE))
GEO_FIELDS = ("continent", "country", "country_code", "city")


def missing_salts(salts: DataFrame, days: DataFrame) -> DataFrame:
    """A random salt for each ``salt_date`` in ``days`` that has none yet.

    The values are random: write the result before anything reads it.
    """
    return (
        days.select("salt_date")
        .filter("salt_date IS NOT NULL")
        .distinct()
        .join(salts, "salt_date", "left_anti")
        .withColumn("salt", F.uuid())
    )


def retained_salts(salts: DataFrame, as_of: Column) -> DataFrame:
    """Salts of the day 24 hours before ``as_of`` and later; older are forgotten."""
    cutoff = F.to_date(as_of.cast("timestamp") - F.make_dt_interval(F.lit(1)))
    return salts.filter(F.col("salt_date") >= cutoff)


def with_salt(hits: DataFrame, salts: DataFrame, at: str = "received_at") -> DataFrame:
    """Add the ``salt`` of the hit's UTC day; NULL if there is none.

    Of several salts for a day the smallest counts, so no hit is doubled.
    """
    daily = salts.groupBy("salt_date").agg(F.min("salt").alias("salt"))
    return (
        hits.withColumn("salt_date", F.to_date(at))
        .join(daily, "salt_date", "left")
        .drop("salt_date")
    )


def ensured_salts(spark: SparkSession, path: str, days: DataFrame) -> DataFrame:
    """The salts on file at ``path``, after adding those that ``days`` still lacks.

    Each day's salt is a file of its own, made once: where two jobs want one for the same
    day, the later one finds the earlier one's and uses that.  What is read here never
    changes afterwards: the rows, one for each day, are held, so that a purge takes none of
    them from a job that began before.  Nothing is written where no day is missing.
    """
    for row in missing_salts(read_salts(spark, path), days).collect():
        put_once(spark, f"{path}/{row.salt_date}{SALT_FILE}", _salt_file(row.salt_date, row.salt))
    return spark.createDataFrame(read_salts(spark, path).collect(), schema.SALTS)


def _salt_file(day: date, salt: str) -> bytes:
    columns = [pa.array([day], pa.date32()), pa.array([salt], pa.string())]
    out = pa.BufferOutputStream()
    pq.write_table(pa.table(columns, schema.SALTS.names), out)
    return out.getvalue().to_pybytes()


def purge_salts(spark: SparkSession, path: str, as_of: datetime) -> list[date]:
    """Delete the salts of days before the one 24 hours before ``as_of`` (UTC).

    Returns the days deleted.  Hits of these days can then not be hashed any more.
    """
    cutoff = (as_of - timedelta(hours=24)).date()
    days = [n.removesuffix(SALT_FILE) for n in names(spark, path) if SALT_DAY.fullmatch(n)]
    old = [day for day in map(date.fromisoformat, days) if day < cutoff]
    for day in old:
        target, fs = file_system(spark, f"{path}/{day}{SALT_FILE}")
        fs.delete(target, False)
    return old


def read_salts(spark: SparkSession, path: str) -> DataFrame:
    """Salts on file; none before the first are written."""
    try:
        return spark.read.schema(schema.SALTS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema.SALTS)


def with_geo(hits: DataFrame, geo: DataFrame | None, ip: str) -> DataFrame:
    """Add the location fields known for the address; NULL if unknown.

    Of several rows for an address the latest counts.  The table grows with the
    addresses seen, so it is not forced to be broadcast: its measured size decides.
    """
    if geo is None:
        return hits.withColumns({f: F.lit(None).cast("string") for f in GEO_FIELDS})
    latest = F.max(F.struct("updated_at", *GEO_FIELDS)).alias("latest")
    known = geo.groupBy(F.col("ip_mask").alias(ip)).agg(latest)
    fields = [F.nullif(F.col(f"latest.{f}"), F.lit("")).alias(f) for f in GEO_FIELDS]
    return hits.join(known.select(ip, *fields), ip, "left")


def network_prefixes(networks: DataFrame) -> DataFrame:
    """One row per network: bits (of 128), high, low, and its latest location fields.

    ``network`` is an address and a length, such as 10.0.0.0/8 or 2001:db8::/32; an address
    alone is a network of one.  Rows that are neither are left out.
    """
    address = F.substring_index("network", "/", 1)
    given = F.regexp_extract("network", r"/([0-9]{1,3})$", 1)
    most = F.when(address.contains(":"), 128).otherwise(32)
    length = F.when(F.col("network").contains("/"), F.nullif(given, F.lit("")).cast("int")).otherwise(most)
    rows = network.with_ip_halves(networks, address).withColumn("bits", length + 128 - most)
    rows = rows.filter((length <= most) & F.col("high").isNotNull())
    rows = rows.withColumns({h: network.masked(F.col(h), F.col("bits") - b) for h, b in (("high", 0), ("low", 64))})
    latest = F.max(F.struct("updated_at", *GEO_FIELDS)).alias("latest")
    return rows.groupBy("bits", "high", "low").agg(latest)


def with_geo_ranges(hits: DataFrame, networks: DataFrame, ip: str) -> DataFrame:
    """Add the location fields of the smallest network that an address lies in, else NULL.

    A longest-prefix match by equality: each different address is cut to every prefix
    length that the table has, at most 129, and these meet the networks; the longest that
    is found counts.  No side is compared by range, and a hot address is one row.
    """
    known = stage(network_prefixes(networks), "geo_prefixes")
    lengths = known.agg(F.sort_array(F.collect_set("bits"))).first()[0]
    seen = network.with_ip_halves(hits.select(ip).distinct(), F.col(ip)).filter("high IS NOT NULL")
    cut = seen.withColumn("bits", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")))
    cut = cut.withColumns({h: network.masked(F.col(h), F.col("bits") - b) for h, b in (("high", 0), ("low", 64))})
    met = cut.join(known, ["bits", "high", "low"])
    found = met.groupBy(ip).agg(F.max(F.struct("bits", "latest")).alias("found"))
    fields = [F.nullif(F.col(f"found.latest.{f}"), F.lit("")).alias(f) for f in GEO_FIELDS]
    return hits.join(found.select(ip, *fields), ip, "left")
