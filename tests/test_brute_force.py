"""Random events with many ties, against plain SQL, on several layouts.

The layouts cut slices short, so all carries across slices and seconds are
exercised; results must not change.
"""

from __future__ import annotations

import random
from datetime import timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from build import at, events
from compare import compare
from footfall.config import Config
from footfall.plans import event_blocks, rollup, sessions
from footfall.plans.reports import session_numbers
from footfall.plans.sessionated import events_sessionated
from footfall.sources.staging import stage
from oracles import base as b
from oracles.queries import BACKFILL

LAYOUTS = [
    Config(),
    Config(bin_seconds=60, session_bin_seconds=300),
    Config(bin_seconds=700, session_bin_seconds=86_400),
    Config(bin_seconds=1, session_bin_seconds=1),
]
NAMES = ["default", "tiny", "odd", "seconds"]
URLS = [
    "https://example.com/",
    "https://example.com/pricing",
    "https://example.com/?utm_source=news",
    "https://example.com/?utm_source=news&utm_medium=email&utm_campaign=c1",
    "https://example.com/?gclid=1",
    "https://example.com/?gclid=2",
    "https://other.org/",
]
REFERRERS = [None, "", "https://www.google.com/", "https://blog.partner.io/x", "https://other.org/y"]


def random_rows(seed: int, n: int = 700) -> list[dict]:
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        visitor = min(rng.randrange(9), 4)  # one visitor has half of the events
        hour = rng.choice([0, 1, 2, 26, 27, 60, 900])
        # the visitor with most events has most of them within one second
        when = at(hour * 60 + rng.randrange(55))
        if visitor == 4 and rng.random() < 0.7:
            when = at(60 * 26 + 7, microseconds=50_000 * rng.randrange(20))
        rows.append(
            {
                "timestamp": when - timedelta(days=170 * (visitor == 3)),
                "hash": f"h{visitor}",
                "client_id": rng.choice([None, None, f"c{visitor // 2}", f"c{visitor // 2}", "x"]),
                "user_id": rng.choice([None] * 12 + ["u1", "u2"]),
                "event_name": rng.choice(["pageview", "pageview", "scroll", "purchase"]),
                "event_type": rng.choice(["event", "request"]),
                "url": rng.choice(URLS),
                "referrer": rng.choice(REFERRERS),
                "user_agent": "bot" if visitor == 2 else "Firefox",
            }
        )
    return rows


@pytest.fixture(scope="module", params=[1, 2])
def case(request, spark):
    table = events(spark, *random_rows(request.param))
    path = spark.conf.get("spark.checkpoint.dir") + f"/random-{request.param}"
    flat = table.withColumns(
        {
            "timestamp": F.col("timestamp").cast("timestamp_ntz"),
            "device_type": F.lit("desktop"),
            "device_brand": F.lit("Dell"),
            "country": F.lit("France"),
        }
    ).drop("device", "location", "ab_test", "consent_given")
    flat.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW tracked AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return table, con


def sql(stages, select: str) -> str:
    return b.chain(*stages[1:]) + select  # the tracked view replaces the adapter


SOURCES = "utm.source AS utm_source, utm.medium AS utm_medium, clid.value AS clid_value"


@pytest.mark.parametrize("cfg", LAYOUTS, ids=NAMES)
def test_models(spark, case, cfg):
    table, con = case
    es = stage(events_sessionated(table, cfg, parameters=False), "es")
    utm = [F.col("utm.source").alias("utm_source"), F.col("utm.medium").alias("utm_medium"),
           F.col("clid.value").alias("clid_value")]
    flags = ["client_id", "no_client_id", "block_id", "session_id", "landing_page", "source_referrer",
             "is_stub_session", "is_ext_session", "is_source_event"]
    _, problems = compare(
        es.select("event_id", *flags, *utm), con,
        sql(b.TO_SESSIONATED, f"SELECT event_id, {', '.join(flags)}, {SOURCES} FROM sessionated"),
    )
    assert not problems
    found = sessions.sessions(es, cfg)
    fields = ["session_id", "client_id", "hash", "hits", "pageviews", "activated", "is_external"]
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_ts", "end_ts", "donor_start_ts")]
    _, problems = compare(
        found.select(*fields, *times, *utm), con,
        sql(b.TO_SESSIONS, f"SELECT {', '.join(fields)}, start_ts, end_ts, donor_start_ts, {SOURCES} FROM sessions"),
    )
    assert not problems
    if cfg is LAYOUTS[0]:
        _, problems = compare(
            rollup.user_map(es, found), con, sql(b.TO_USERS, "SELECT session_id, user_id FROM user_map")
        )
        assert not problems
    paths = rollup.clients(found, cfg).select("client_id", "touchpoints", "sessions")
    _, problems = compare(paths, con, sql(b.TO_SESSIONS, """
        SELECT client_id, string_agg(CASE WHEN is_external THEN coalesce(utm.source, '') || '/'
          || coalesce(utm.medium, '') || ':' || coalesce(utm.campaign, '') END, ' > '
          ORDER BY start_ts, session_id) AS touchpoints, count(*) AS sessions FROM sessions GROUP BY 1"""))
    assert not problems


@pytest.mark.parametrize("cfg", LAYOUTS, ids=NAMES)
def test_backfill(case, cfg):
    table, con = case
    rows = event_blocks.backfilled(table, cfg)
    _, problems = compare(
        rows.select("event_id", F.col("block_end").cast("timestamp_ntz").alias("block_end"),
                    "pass1", "pass2", "pass3", "cookiebot_fix"),
        con,
        sql(BACKFILL, "SELECT event_id, block_end, pass1, pass2, pass3, cookiebot_fix FROM p3"),
    )
    assert not problems


def test_session_numbers(case):
    table, con = case
    _, problems = compare(
        session_numbers(table).select("event_id", F.col("session_number").cast("long").alias("session_number")),
        con,
        """
        SELECT event_id, CAST(sum(fresh) OVER (PARTITION BY client_id ORDER BY "timestamp") AS BIGINT) AS session_number
        FROM (SELECT *, CASE WHEN date_sub('minute', lag("timestamp") OVER (
                PARTITION BY client_id ORDER BY "timestamp", event_id), "timestamp") > 30 THEN 1 ELSE 0 END AS fresh
              FROM tracked)""",
    )
    assert not problems
