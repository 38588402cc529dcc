"""Ingest, tables and streams."""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from build import at, column, events
from footfall import schema
from footfall.functions.ids import plain_hash
from footfall.operators import event_ids
from footfall.plans import quality, reports
from footfall.plans.sessionated import events_sessionated
from footfall.sources import dimensions, hits, incremental, models, once, staging
from footfall.sources import events as tables
from footfall.streaming import jobs

AGENT = "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) Version/17.2 Mobile Safari/604.1"


def landed(spark, *rows: dict):
    full = []
    for row in rows:
        base = {"received_at": at(), "remote_addr": "1.2.3.4", "headers": {"user-agent": AGENT},
                "cookies": {}, "query": {}, "form": {}, "json": None}
        body = row.get("json")
        base.update(row, json=json.dumps(body) if isinstance(body, (dict, list)) else body)
        full.append(base)
    return spark.createDataFrame(full, schema.HITS)


@pytest.fixture(scope="module")
def salts(spark):
    rows = [(date(2024, 3, 1), "one"), (date(2024, 3, 2), "two")]
    return spark.createDataFrame(rows, schema.SALTS)


def test_body_form_and_query_are_merged_by_presence(spark):
    rows = hits.merge_payload(
        landed(
            spark,
            {"query": {"en": "a", "url": "q"}, "form": {"en": "b"}, "json": {"en": "c"}},
            {"query": {"en": "a"}, "form": {"en": "b"}, "json": "not json"},
            {"query": {"en": "a"}, "form": {"en": "b"}, "json": {"en": ""}},
            {"query": {"en": "a"}, "json": [1]},
        )
    ).select("en", "url").collect()
    assert [r.en for r in rows] == ["c", "b", "", "a"] and rows[0].url == "q"


def test_processing(spark, salts):
    geo = spark.createDataFrame([("1.2.3.4", "Europe", "France", "FR", "", None)], schema.GEO)
    rows = hits.process_hits(
        landed(
            spark,
            {"json": {"en": "test-1", "url": "https://example.com/test", "r": "https://google.com",
                      "p": {"test": True, "a": [1, 2]}}},
            {"query": {"et": "pageview", "en": "x", "c": "me", "u": "u1"}, "remote_addr": "127.0.0.1"},
            {"json": {"en": "x", "p": "text"}, "headers": {"user-agent": AGENT, "x-forwarded-for": "9.9.9.9"}},
            {"received_at": at() + timedelta(days=1), "json": {"en": "x"}},
        ),
        salts,
        geo,
    ).collect()
    first, second, third, fourth = sorted(rows, key=lambda r: (r.timestamp, r.event_name, -len(r.parameters), r.event_type))
    by_type = {r.event_type: r for r in rows if r.event_type == "pageview"}
    sent = next(r for r in rows if r.event_name == "test-1")
    assert sent.parameters == '{"test":true,"a":[1,2]}' and sent.event_type == "event"
    assert sent.location.country == "France" and sent.location.city is None
    assert sent.location.ip_trunc == "1.2.3.0" and sent.device.os == "iOS" and sent.device.browser
    assert sent.client_id is None and not sent.consent_given
    view = by_type["pageview"]
    assert (view.client_id, view.user_id, view.consent_given, view.parameters) == ("me", "u1", True, "{}")
    assert view.location.ip_trunc == "2a02:3100:1da8:1d00::" and view.location.country is None
    text = next(r for r in rows if r.parameters == '"text"')
    assert text.hash != sent.hash and text.location.ip_trunc == "9.9.9.0"
    next_day = next(r for r in rows if r.timestamp > at(60))
    assert next_day.hash != sent.hash
    same = hits.process_hits(landed(spark, {"json": {"en": "y"}}), salts, geo, False).first()
    assert same.hash == sent.hash and same.client_id == ""


def test_consent(spark, salts):
    rows = landed(
        spark,
        {"json": {"en": "consent", "p": {"id": True}}},
        {"json": {"en": "consent", "p": {"analytics": True}}, "received_at": at(1)},
        {"json": {"en": "consent", "p": {"id": "true"}}, "received_at": at(2)},
        {"json": {"en": "other", "p": {"id": False}}, "received_at": at(3)},
        {"json": {"en": "consent", "p": {"id": False}}, "received_at": at(4), "remote_addr": "5.5.5.5"},
    )
    done = hits.with_defaults(rows, salts).orderBy("received_at").collect()
    assert [r.consent for r in done] == [True, None, None, None, False]
    assert len(done[0].c) == 36 and done[1].c is None
    again = hits.with_defaults(rows, salts).orderBy("received_at").first()
    assert again.c == done[0].c  # the same on a retry
    ledger = {r.hash: r for r in hits.consent_ledger(rows, salts).collect()}
    assert ledger[done[0].h].client_id == done[0].c and ledger[done[0].h].consent
    assert ledger[done[4].h].client_id is None and not ledger[done[4].h].consent


def test_validation(spark):
    good, bad = hits.split_hits(
        landed(
            spark,
            {"json": {"en": "a", "p": {"x": 1}}},
            {"json": {"en": "a"}},
            {"json": {"en": ""}},
            {"json": {"en": 5}},
            {"json": {"en": "a", "p": "text"}},
            {"json": {"p": 3}},
        )
    )
    assert good.count() == 2
    assert sorted(len(r.reasons) for r in bad.collect()) == [1, 1, 1, 2]


def test_salts(spark, salts):
    days = spark.createDataFrame([(date(2024, 3, 2),), (date(2024, 3, 3),), (date(2024, 3, 3),)], "salt_date date")
    made = dimensions.missing_salts(salts, days).collect()
    assert [r.salt_date for r in made] == [date(2024, 3, 3)] and len(made[0].salt) == 36
    kept = dimensions.retained_salts(salts, F.lit("2024-03-03 05:00:00")).collect()
    assert [r.salt for r in kept] == ["two"]


def test_a_salt_is_made_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "salts")
    days = spark.createDataFrame([(date(2024, 3, d),) for d in (1, 1, 2, 3)] + [(None,)], "salt_date date")
    put, other = dimensions.put_once, {}

    def interleaved(session, target, content):
        """Another job makes all salts between this one's look and its write."""
        monkeypatch.setattr(dimensions, "put_once", put)
        if not other:
            rows = dimensions.ensured_salts(spark, path, days.filter("salt_date <= '2024-03-02'")).collect()
            other.update({r.salt_date: r.salt for r in rows})
        return put(session, target, content)

    monkeypatch.setattr(dimensions, "put_once", interleaved)
    found = {r.salt_date: r.salt for r in dimensions.ensured_salts(spark, path, days).collect()}
    assert len(found) == 3 and len(other) == 2 and found.items() >= other.items()
    files = once.names(spark, path)
    assert len(files) == 3
    again = dimensions.ensured_salts(spark, path, days).collect()
    assert {r.salt_date: r.salt for r in again} == found and once.names(spark, path) == files
    assert dimensions.purge_salts(spark, path, datetime(2024, 3, 4, 1)) == [date(2024, 3, 1), date(2024, 3, 2)]
    assert [r.salt_date for r in dimensions.read_salts(spark, path).collect()] == [date(2024, 3, 3)]
    assert not list((tmp_path / "salts").glob(".*"))


def test_a_purge_leaves_salts_that_were_read(spark, tmp_path):
    path = str(tmp_path / "salts")
    days = spark.createDataFrame([(date(2024, 3, d),) for d in (1, 2, 3)], "salt_date date")
    first = dimensions.ensured_salts(spark, path, days)
    assert dimensions.purge_salts(spark, path, datetime(2024, 3, 4, 1)) == [date(2024, 3, 1), date(2024, 3, 2)]
    assert first.count() == 3 and dimensions.read_salts(spark, path).count() == 1
    again = {r.salt_date: r.salt for r in dimensions.ensured_salts(spark, path, days).collect()}
    kept = {r.salt_date: r.salt for r in first.collect()}
    assert [day for day in kept if kept[day] == again[day]] == [date(2024, 3, 3)]


@pytest.mark.parametrize("way", ["_link", "_rename"])
def test_a_file_is_made_once(spark, tmp_path, monkeypatch, way):
    monkeypatch.setattr(once, "_link", getattr(once, way))
    path = str(tmp_path / "folder" / "file")
    assert once.names(spark, str(tmp_path / "folder")) == []
    assert once.put_once(spark, path, b"one") and not once.put_once(spark, path, b"two")
    # a rival comes between the look and the last step
    real = once.file_system

    def blind(session, target):
        found, fs = real(session, target)
        return found, type("Blind", (), {"exists": lambda *_: False, "create": fs.create, "delete": fs.delete})()

    monkeypatch.setattr(once, "file_system", blind)
    assert not once.put_once(spark, path, b"three")
    assert (tmp_path / "folder" / "file").read_bytes() == b"one"


def test_ids_of_a_batch_stay(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = raw(spark, *[{"hash": None if i == 3 else "h", "timestamp": at(i % 4, microseconds=i % 2)} for i in range(12)])
    ids = []
    for given in (rows, rows.repartition(5), rows.orderBy(F.desc("timestamp"))):
        tables.append_events(given, path, "one")
        found = tables.read_events(spark, path)
        ids.append(sorted((r.event_id, r.timestamp) for r in found.collect()))
    assert ids[0] == ids[1] == ids[2] and len({i for i, _ in ids[0]}) == 12 and None not in dict(ids[0])
    tables.append_events(rows, path, "two")
    assert tables.read_events(spark, path).select("event_id").distinct().count() == 24
    one, two = (event_ids.with_batch_ids(rows.limit(1), b).first().event_id for b in ("a", "b"))
    assert one != two


def raw(spark, *rows):
    return events(spark, *rows).drop("event_id")


def test_events_table(spark, tmp_path):
    path = str(tmp_path / "events")
    tables.append_events(raw(spark, {}, {"timestamp": at(24 * 60)}), path)
    for _ in range(2):  # a repeated write of one batch replaces itself
        tables.append_events(raw(spark, {"hash": "h2"}), path, "again")
    found = tables.read_events(spark, path)
    assert found.count() == 3 and found.select("event_id").distinct().count() == 3
    day = tables.read_events(spark, path, date(2024, 3, 2), date(2024, 3, 2))
    assert day.count() == 1
    assert "PartitionFilters: [isnotnull(event_date" in day._jdf.queryExecution().toString()


def test_whole_days_are_replaced(spark, tmp_path):
    path = str(tmp_path / "derived")
    tables.overwrite_days(tables.with_day(raw(spark, {}, {"timestamp": at(24 * 60)})), path)
    tables.overwrite_days(tables.with_day(raw(spark, {"hash": "new"})), path)
    assert sorted(r.hash for r in spark.read.parquet(path).collect()) == ["h", "new"]


def test_retention_of_a_table(spark):
    rows = tables.with_day(raw(spark, {}, {"timestamp": at(-60 * 24 * 500)}))
    rows.write.mode("overwrite").partitionBy("event_date").format("parquet").saveAsTable("raw_events")
    assert tables.retained(rows, F.lit(date(2024, 3, 5))).count() == 1
    assert len(tables.purge_expired(spark, "raw_events", date(2024, 3, 5))) == 1
    assert spark.table("raw_events").count() == 1


def test_publishing(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS web_dev")
    daily = spark.createDataFrame([(date(2024, 3, 1), 1)], "date date, n int")
    models.publish_tables({"daily": daily}, "web", dev=True, partition_by={"daily": "date"})
    assert models.read_model(spark, "daily", "web", dev=True).count() == 1
    models.publish_views({"daily_view": daily})
    assert spark.sql("SELECT n FROM daily_view").first()[0] == 1


def test_incremental_refresh(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = [{"timestamp": at(60 * 7 * i), "client_id": f"c{i % 3}"} for i in range(30)]
    table = events(spark, *rows)
    known = (F.col("timestamp") < at(60 * 80)) & (F.to_date("timestamp") != date(2024, 3, 3))
    incremental.refresh_days(table.filter(known), path)
    for _ in range(2):  # repeating changes nothing; 3 March comes late
        incremental.refresh_days(table, path, table.filter(~known))
    found = incremental.users_from_days(incremental.read_days(spark, path))
    full = table.groupBy("client_id", "user_id").agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.count_distinct(F.to_date("timestamp")).alias("days_active"),
    )
    assert found.exceptAll(full).isEmpty() and full.exceptAll(found).isEmpty()
    nothing = table.limit(0)
    assert incremental.touched_days(nothing, 3) == []
    incremental.refresh_sessionated(table, str(tmp_path / "none"), nothing)
    assert not (tmp_path / "none").exists()


def test_staged_tables_are_removed(spark):
    with staging.staging_run(spark) as folder:
        kept = staging.stage(spark.range(3), "numbers")
        assert kept.count() == 3 and folder in kept.inputFiles()[0]
    assert not Path(folder).exists()


def test_staging_needs_a_shared_folder(spark):
    assert staging.staging_root(spark) == spark.conf.get("spark.checkpoint.dir")
    kept = staging.stage(spark.range(3), "numbers")
    assert kept.count() == 3 and "numbers" in kept.inputFiles()[0]


def test_quality(spark):
    table = spark.createDataFrame([(1, "a"), (1, None)], "event_id int, client_id string")
    checks = {"null": quality.not_null(table, "client_id"), "unique": quality.unique(table, "event_id")}
    assert {r.check_name: r.failures for r in quality.failures(checks).collect()} == {"null": 1, "unique": 1}
    assert {r.column_name: r.nulls for r in quality.null_counts(table).collect()} == {"event_id": 0, "client_id": 1}


def test_bursts(spark):
    rows = [{"timestamp": at(seconds=i * 0.5)} for i in range(101)] + [{"hash": "calm"}]
    found = reports.burst_flags(events(spark, *rows)).collect()
    assert [(r.hash, r.window_start, r.events) for r in found] == [("h", at(), 101)]


def test_hits_stream_equals_batch(spark, salts, tmp_path):
    rows = [
        {"received_at": at(i), "remote_addr": f"1.2.3.{i}", "json": {"en": f"e{i}", "p": {"n": i}}} for i in range(6)
    ]
    source, out, known = (str(tmp_path / n) for n in ("hits", "events", "salts"))
    landed(spark, *rows[:3]).write.json(source)
    salts.write.parquet(known)

    def run():
        stream = jobs.read_hits(spark, source, files_per_batch=1)
        jobs.ingest(stream, known, out, str(tmp_path / "checkpoint")).awaitTermination()

    run()
    landed(spark, *rows[3:]).write.mode("append").json(source)
    run()
    run()  # nothing new, nothing twice
    found = tables.read_events(spark, out).drop("event_date", "event_id")
    batch = hits.process_hits(landed(spark, *rows), salts)
    assert found.count() == 6
    assert found.exceptAll(batch).isEmpty()


def test_a_new_day_gets_a_salt(spark, tmp_path):
    source, out, known = (str(tmp_path / n) for n in ("hits", "events", "salts"))
    for day in range(3):
        rows = [{"received_at": at(60 * 24 * day + i), "json": {"en": "e"}} for i in range(2)]
        landed(spark, *rows).write.mode("append").json(source)
        stream = jobs.read_hits(spark, source)
        jobs.ingest(stream, known, out, str(tmp_path / "checkpoint")).awaitTermination()
    found = tables.read_events(spark, out)
    assert hits.rejected_events(found).isEmpty()
    assert found.select("hash").distinct().count() == 3  # one visitor, three days
    assert dimensions.read_salts(spark, known).count() == 3


def test_networks(spark):
    rows = [("10.0.0.0/8", "a"), ("10.1.0.0/16", "b"), ("10.1.2.3", "c"), ("2001:DB8::/32", "d"), ("2001:db8:0:1::/64", "e"),
            ("2001:db8::1", "f"), ("bad/8", "x"), ("10.0.0.0/33", "x"), ("1.2.3.4/", "x"), ("::ffff:9.9.0.0/112", "g"),
            ("10.1.255.255/16", "b"), ("8.0.0.0/5", "h")]
    made = [(n, None, c, c, "", None) for n, c in rows] + [("10.1.0.0/16", None, "old", "o", "", datetime(2020, 1, 1))]
    made.append(("10.1.0.0/16", None, "new", "n", "", datetime(2024, 1, 1)))
    kinds = "network string, continent string, country string, country_code string, city string, updated_at timestamp"
    networks = spark.createDataFrame(made, kinds)
    want = {
        "10.2.3.4": "a", "10.1.9.9": "new", "10.1.2.3": "c", "::ffff:10.1.2.3": "c", "0:0:0:0:0:FFFF:10.1.2.3": "c",
        "2001:db8:5::": "d", "2001:0db8:0000:0001:0000:0000:0000:0007": "e", "2001:db8:0:0::1": "f", "9.9.1.2": "g", "9.8.1.2": "h",
        "9.9.0.7": "g", "16.0.0.0": None, "": None, "1.2.3": None, "1.2.3.256": None, "1::2::3": None, ":1": None,
        "1:2:3:4:5:6:7": None, "1:2:3:4:5:6:7:8:9": None, "::": None, "10.1.2.3 ": None, None: None, "12345::": None,
    }
    hits_ = spark.createDataFrame([(ip,) for ip in [*want, "10.2.3.4"]], "ip string")
    found = dimensions.with_geo_ranges(hits_, networks, "ip").collect()
    assert len(found) == len(want) + 1 and {r.ip: r.country for r in found} == want
    none = dimensions.with_geo_ranges(hits_, networks.limit(0), "ip").collect()
    assert len(none) == len(want) + 1 and not any(r.country for r in none)


def test_doubled_dimensions_do_not_double_hits(spark, salts):
    geo = spark.createDataFrame([("1.2.3.4", "Europe", "France", "FR", "", None)] * 2, schema.GEO)
    rows = hits.process_hits(landed(spark, {"json": {"en": "a"}}), salts.union(salts), geo)
    assert rows.count() == 1


def test_hits_without_salt_are_reported(spark, salts):
    rows = [{"received_at": at(60 * 24 * 9), "json": {"en": "a"}}, {"json": {"en": "b"}}, {"received_at": None}]
    lost = hits.rejected_events(hits.process_hits(landed(spark, *rows), salts)).collect()
    assert sorted(r.reason for r in lost) == ["no_hash", "no_time"]


def test_false_and_zero_count_as_not_given(spark, salts):
    bodies = [
        {"en": "a", "c": False, "u": 0}, {"en": "a", "c": 0, "h": False, "et": 0}, {"en": "a", "c": 0.0, "ua": None},
        {"en": "a", "c": "false", "h": "0"}, {"en": "a", "c": "0", "et": "0"},
    ]
    rows = [hits.process_hits(landed(spark, {"json": b}), salts).first() for b in bodies]
    assert [r.client_id for r in rows] == [None, None, None, "false", "0"]
    assert [r.consent_given for r in rows] == [False, False, False, True, True]
    assert [r.event_type for r in rows] == ["event"] * 4 + ["0"]
    assert rows[0].hash == rows[1].hash and rows[3].hash == "0" and rows[0].user_id == "0"
    form = landed(spark, {"form": {"en": "a", "c": "0", "et": "false"}})
    row = hits.process_hits(form, salts).first()
    assert (row.client_id, row.event_type) == ("0", "false")


def test_sessions_stream_equals_batch(spark, tmp_path):
    path, out = str(tmp_path / "raw"), str(tmp_path / "es")
    rows = [
        {"timestamp": at(60 * 11 + 9 * i), "hash": f"h{i % 2}", "client_id": "A" if i % 7 == 0 else None} for i in range(40)
    ]  # over midnight
    late = {"timestamp": at(60 * 11 + 1), "hash": "h0", "url": "https://example.com/?gclid=1"}
    ids = (plain_hash(F.col("session_id")).alias("s"), "timestamp", "hash", "client_id")

    def run():
        jobs.sessionate_stream(spark, path, out, str(tmp_path / "cp")).awaitTermination()

    tables.append_events(raw(spark, *rows[:25]), path)
    run()
    tables.append_events(raw(spark, *rows[25:]), path)
    run()
    tables.append_events(raw(spark, late), path)
    run()
    batch = events_sessionated(tables.read_events(spark, path).drop("event_date"), parameters=False)
    found = spark.read.parquet(out)
    assert found.count() == 41
    assert found.select(*ids).exceptAll(batch.select(*ids)).isEmpty()


def test_live_bursts(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = [{"timestamp": at(seconds=i)} for i in range(5)] + [{"timestamp": at(60)}]
    tables.append_events(raw(spark, *rows), path)
    stream = spark.readStream.schema(tables.read_events(spark, path).schema).parquet(path)
    out = str(tmp_path / "bursts")
    jobs.write_stream(jobs.live_bursts(stream, limit=3), out, str(tmp_path / "cp")).awaitTermination()
    assert [r.events for r in spark.read.parquet(out).collect()] == [5]


def test_reports(spark):
    df = events(
        spark,
        {"timestamp": at(0), "client_id": "A"},
        {"timestamp": at(0), "client_id": "A", "event_name": "purchase"},
        {"timestamp": at(60 * 24 * 8), "client_id": "A"},
        {"timestamp": at(1), "client_id": "B", "event_name": "purchase"},
    )
    visits = {(r.client_id, str(r.date)): r.is_returning for r in reports.returning_visitors(df).collect()}
    assert visits == {("A", "2024-03-01"): False, ("A", "2024-03-09"): True, ("B", "2024-03-01"): False}
    steps = [r.clients for r in reports.funnel(df, ("pageview", "purchase")).orderBy("step").collect()]
    assert steps == [1, 1]
    assert sorted((r.week_offset, r.clients) for r in reports.retention(df).collect()) == [(0, 2), (1, 1)]
    latest = reports.recent_events(df, 2, "pageview")
    assert column(latest, "event_name") == ["pageview", "pageview"] and latest.count() == 2
