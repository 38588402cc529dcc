"""Refreshed clients and users against those built from all sessions."""

from __future__ import annotations

from build import at, events
from pyspark.sql import functions as F

from footfall.plans import rollup
from footfall.sources import events as tables
from footfall.sources import incremental, rollup_refresh
from footfall.sources.staging import stage


def refresh(spark, root, part):
    tables.append_events(part.drop("event_id"), f"{root}/raw", str(part.agg(F.min("event_id")).first()[0]))
    raw = tables.read_events(spark, f"{root}/raw")
    incremental.refresh_sessionated(raw, f"{root}/sessionated", part)
    rows = spark.read.parquet(f"{root}/sessionated")
    incremental.refresh_sessions(rows, f"{root}/sessions", part)
    visits = spark.read.parquet(f"{root}/sessions")
    rollup_refresh.refresh_rollups(rows, visits, f"{root}/rollups", part)
    return rows, visits


def same(found, full):
    return found.exceptAll(full).isEmpty() and full.exceptAll(found).isEmpty()


DAY = 24 * 60
BOT_FREE = {"user_agent": "Mozilla/5.0 (X11; Linux x86_64) Firefox/120"}


def hit(minutes, visitor, client=None, user=None):
    return {
        "timestamp": at(minutes), "hash": visitor, "client_id": client, "user_id": user,
        "referrer": f"https://{visitor}.example.net/", **BOT_FREE,
    }


def test_late_rows_move_and_remove_sessions(spark, tmp_path):
    midnight = 12 * 60
    table = events(
        spark,
        hit(0, "a", "c1", "u1"), hit(40 * DAY, "a", "c1"), hit(40 * DAY + 50, "a2", "c1", "u2"),
        hit(midnight + 5, "b", "c2"), hit(60, "n", None, "u1"), hit(90 * DAY, "n2", None, "u3"),
        # late: joins the session after midnight, which then starts a day before
        hit(midnight - 5, "b", "c2", "u2"), hit(40 * DAY - 9, "a", "c1", "u3"), hit(61, "n", "c3", "u4"),
    )
    first, late = table.filter("event_id < 6"), table.filter("event_id >= 6")
    refresh(spark, tmp_path, first)
    for _ in range(2):  # repeating changes nothing
        rows, visits = refresh(spark, tmp_path, late)
    assert visits.filter(F.col("event_date") == at(midnight + 5).date()).isEmpty()
    visits, rows = stage(visits.drop("event_date"), "visits"), stage(rows, "rows")
    path = str(tmp_path / "rollups")
    clients = rollup.clients(visits)
    assert clients.count() >= 3 and same(rollup_refresh.refreshed_clients(spark, path), clients)
    users = rollup.users(visits, rollup.owners(rows, visits))
    assert users.count() >= 3 and same(rollup_refresh.refreshed_users(spark, path), users)
    months = spark.read.parquet(f"{path}/clients/months")
    assert months.count() < visits.count() + 1 and months.select("event_month").distinct().count() == 3


def test_nothing_arrived(spark, tmp_path):
    nothing = events(spark, hit(0, "a")).limit(0)
    rollup_refresh.refresh_rollups(nothing, nothing, str(tmp_path / "none"), nothing)
    assert not (tmp_path / "none").exists()
