"""Hand-built cases for blocks, identity, sources, sessions and roll-ups."""

from __future__ import annotations

import random
import re
from dataclasses import replace
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from build import at, column, events
from footfall.config import DEFAULT
from footfall.functions import ids
from footfall.operators import attribution, carry, event_ids, identity, lookback, timeline
from footfall.operators.carry import SECOND
from footfall.plans import event_blocks, rollup, sessions
from footfall.plans.sessionated import events_sessionated, visit_facts, with_facts
from footfall.sources.staging import stage

OLD = datetime(2023, 9, 1, 12)


def blocks(df):
    return column(timeline.with_blocks(df), "block_start")


def test_gap_is_strict_and_in_whole_milliseconds(spark):
    pauses = {"a": 1_800_000_000, "b": 1_800_000_900, "c": 1_800_001_000}
    rows = []
    for hash, micros in pauses.items():
        rows += [{"hash": hash}, {"hash": hash, "timestamp": at(microseconds=micros)}]
    starts = blocks(events(spark, *rows))
    assert [starts[i] == starts[i + 1] for i in (0, 2, 4)] == [True, True, False]


def test_equal_times_share_a_block(spark):
    df = events(spark, {"timestamp": at(0)}, {"timestamp": at(0)}, {"timestamp": at(40)}, {"timestamp": at(40)})
    assert blocks(df) == [at(0), at(0), at(40), at(40)]


def merged(spark, times_and_ids, base=None, cfg=DEFAULT):
    rows = [
        {"timestamp": (base or at()) + timedelta(minutes=m), "client_id": c} for m, c in times_and_ids
    ]
    df = identity.merged_client_ids(events(spark, *rows), cfg)
    return column(df, "client_id"), column(df, "no_client_id")


def test_own_id_is_kept_and_missing_ones_take_the_first(spark):
    ids, none = merged(spark, [(0, None), (1, "A"), (2, None), (3, "B")])
    assert ids == ["A", "A", "A", "B"] and not any(none)


def test_without_ids_the_hash_is_the_client(spark):
    ids, none = merged(spark, [(0, None), (1, None)])
    assert ids == ["h", "h"] and all(none)


def test_legacy_blocks(spark):
    assert merged(spark, [(0, "A"), (1, "B"), (2, None)], OLD)[0] == ["B", "B", "B"]
    assert merged(spark, [(0, "A"), (1, None)], OLD)[0] == ["A", "A"]
    assert merged(spark, [(0, "A"), (1, "B"), (2, "C")], OLD)[0] == ["A", "A", "A"]
    no_era = replace(DEFAULT, legacy_id_cutoff=None)
    assert merged(spark, [(0, "A"), (1, "B"), (2, None)], OLD, no_era)[0] == ["A", "B", "A"]


# client ids by minute, the result, and whether the block was repaired
BACKFILL = [
    ([(0, None), (1, "A"), (2, None)], ["A", "A", "A"], 0),
    ([(0, "A"), (1, "B"), (2, None)], ["B", "B", "B"], 1),
    ([(0, "A"), (1, "B"), (2, "A"), (3, None)], ["A", "B", "A", "h2"], 0),
    ([(0, "A"), (1, "B"), (2, "A"), (3, "B"), (4, "C"), (5, "D")], ["D"] * 6, 1),
    # the same over several slices of one block
    ([(0, None), (25, None), (50, "A"), (75, None), (100, "B"), (125, None)], ["B"] * 6, 1),
    ([(0, None), (25, "A"), (50, "B"), (75, "A"), (100, None)], ["A", "A", "B", "A", "h5"], 0),
]


def test_backfill(spark):
    rows = [
        {"timestamp": at(m), "client_id": c, "hash": f"h{i}"}
        for i, (given, _, _) in enumerate(BACKFILL)
        for m, c in given
    ]
    df = event_blocks.event_blocks(events(spark, *rows))
    found = df.select("event_id", "client_id", "cookiebot_fix").orderBy("event_id").collect()
    assert [r.client_id for r in found] == [c for _, ids, _ in BACKFILL for c in ids]
    assert [r.cookiebot_fix for r in found] == [fix for _, ids, fix in BACKFILL for _ in ids]


def test_event_ids(spark):
    rows = [{"url": "a"}, {"url": "b"}, {"url": "b"}, {"timestamp": at(1)}]
    df = events(spark, *rows).withColumnRenamed("event_id", "position")
    plain = event_ids.with_event_ids(df.drop("position")).select("event_id").collect()
    assert len({r.event_id for r in plain}) == 4
    again = event_ids.with_event_ids(df.drop("position").repartition(3)).select("event_id").collect()
    assert {r.event_id for r in plain} == {r.event_id for r in again}
    placed = event_ids.with_event_ids(df, "position")
    assert len(set(column(placed, "event_id", "position"))) == 4


def test_event_ids_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(event_ids, "STEP", 7)
    df = events(spark, {}, {"url": "b"}).drop("event_id")
    for _ in range(6):
        df = df.union(df)
    named = event_ids.with_event_ids(df)
    assert named.count() == 128 and named.select("event_id").distinct().count() == 128
    assert named.drop("event_id").exceptAll(df).isEmpty()


NEWS = "https://example.com/?utm_source=news&utm_medium=email&utm_campaign=c1"


def test_sources_split_blocks(spark):
    df = events_sessionated(
        events(
            spark,
            {"timestamp": at(0), "event_name": "scroll"},  # before the first pageview
            {"timestamp": at(1)},  # direct
            {"timestamp": at(2)},  # direct again: same session
            {"timestamp": at(3), "url": NEWS},
            {"timestamp": at(4), "event_name": "scroll"},
            {"timestamp": at(5), "url": NEWS},  # the same source: same session
            {"timestamp": at(29), "event_name": "scroll"},
            {"timestamp": at(55), "event_name": "scroll"},  # later slices of the block
            {"timestamp": at(100), "event_name": "scroll"},  # a block without pageviews
        ),
        parameters=False,
    )
    ids = column(df, "session_id")
    assert len(set(ids[:3])) == 1 and len(set(ids[3:8])) == 1 and len(set(ids)) == 3
    assert column(df, "is_stub_session") == [False] * 8 + [True]
    assert column(df, "is_ext_session") == [False] * 3 + [True] * 5 + [False]
    assert column(df, "is_source_event") == [False, True, False, True] + [False] * 4 + [None]
    assert column(df, "block_id")[0] != ids[0] and column(df, "block_id")[8] == ids[8]
    assert [u.source for u in column(df, "utm")] == ["direct"] * 3 + ["news"] * 5 + ["direct"]
    assert column(df, "landing_page")[3] == "/"


RULES = [
    ({"url": "https://example.com/?gclid=1"}, "google", "cpc"),
    ({"url": "https://example.com/?fbclid=1"}, "facebook", "(not set)"),
    ({"referrer": "https://www.google.com/"}, "google", "organic"),
    ({"referrer": "https://blog.partner.io/"}, "referring_domain", "referral"),
    ({"url": "https://example.com/?utm_source=news"}, "news", "none"),
    ({"url": "https://example.com/?utm_source=x&gclid=1"}, "x", "cpc"),
    ({"referrer": "https://checkout.stripe.com/"}, "direct", "none"),
    ({}, "direct", "none"),
]


def test_rules(spark):
    rows = [{**row, "hash": f"h{i}"} for i, (row, _, _) in enumerate(RULES)]
    found = column(events_sessionated(events(spark, *rows), parameters=False), "utm")
    assert [(u.source, u.medium) for u in found] == [(s, m) for _, s, m in RULES]


def found_sessions(spark, *rows, cfg=DEFAULT):
    es = events_sessionated(events(spark, *rows), cfg, parameters=False)
    return sessions.sessions(es, cfg).orderBy("start_ts").collect()


LOOKBACK = [
    ("A", timedelta(days=29, hours=23), "news"),
    ("B", timedelta(days=30), "direct"),
    (None, timedelta(hours=23), "news"),
    (None, timedelta(hours=24), "direct"),
]


def test_lookback(spark):
    rows = []
    for i, (client, later, _) in enumerate(LOOKBACK):
        # The hash of a known client changes daily.
        again = f"again{i}" if client else f"h{i}"
        rows.append({"url": NEWS, "client_id": client, "hash": f"h{i}"})
        rows.append({"timestamp": at() + later, "client_id": client, "hash": again})
    found = {r.start_ts: r for r in found_sessions(spark, *rows) if r.start_ts > at()}
    for _, later, source in LOOKBACK:
        row = found[at() + later]
        assert row.utm.source == source
        assert row.donor_start_ts == (at() if source == "news" else None)


def test_unknown_agents_and_bots_are_dropped_but_donate(spark):
    bot = {"url": NEWS, "client_id": "A", "user_agent": "Googlebot"}
    unknown = {"timestamp": at(60), "user_agent": None, "device": None, "client_id": "A"}
    person = {"timestamp": at(120), "client_id": "A"}
    rows = found_sessions(spark, bot, unknown, person)
    assert [(r.start_ts, r.utm.source) for r in rows] == [(at(120), "news")]


def test_metrics_keep_operator_precedence(spark):
    login = "https://example.com/login"
    rows = found_sessions(
        spark, {}, {"timestamp": at(1), "event_name": "scroll", "url": login},
        {"timestamp": at(2), "event_name": "scroll", "url": "https://example.com/pricing"},
    )
    assert (rows[0].activated, rows[0].logged_in, rows[0].pageviews, rows[0].hits) == (1, 0, 1, 3)


def test_paths_and_users(spark):
    bare = "https://example.com/?utm_source=d&utm_medium=e"
    es = events_sessionated(
        events(
            spark,
            {"client_id": "A", "url": "https://example.com/?utm_source=a&utm_medium=b&utm_campaign=c"},
            {"client_id": "A", "timestamp": at(60 * 24 * 40), "hash": "h2"},
            {"client_id": "A", "timestamp": at(60 * 24 * 41), "hash": "h3", "url": bare, "user_id": "u1"},
            {"hash": "x", "timestamp": at(5)},
            {"hash": "y", "timestamp": at(5), "user_id": "u2"},
        ),
        parameters=False,
    )
    found = sessions.sessions(es)
    clients = {r.client_id: r for r in rollup.clients(found, paths=True).collect()}
    assert clients["A"].touchpoints == "a/b:c > d/e:" and clients["A"].sessions == 3
    assert clients["x"].touchpoints is None and clients["x"].no_client_id
    assert (clients["A"].first_utm.source, clients["A"].last_utm.source) == ("a", "d")

    whose = rollup.owners(es, found)
    mapping = rollup.user_map(whose, found)
    ids = {r.session_id for r in found.filter("client_id = 'A'").collect()}
    assert {r.session_id for r in mapping.filter("user_id = 'u1'").collect()} == ids
    assert mapping.filter("user_id IS NULL").count() == len(ids) + 1  # NULL users stay in the map
    users = {r.user_id: r for r in rollup.users(found, whose, paths=True).collect()}
    assert set(users) == {"u1", "u2"}
    assert users["u1"].touchpoints == "a/b:c > d/e:" and users["u1"].sessions == 3
    lists = {r.user_id: r.steps for r in rollup.user_sources(found, whose).collect()}
    assert [s.utm.source for s in lists["u1"]] == ["a", "d"] and "u2" not in lists
    assert [s.start_ts for s in lists["u1"]] == [at(), at(60 * 24 * 41)]
    assert users["u2"].touchpoints is None and users["u2"].sessions == 1 and users["u2"].ext_sources == 0


def visits(spark, *rows):
    """Sessions by (client, session, minute, source); no source: not external."""
    made = [
        (c, s, at(m), at(m + 5), (source, "m", "c", None, None, None), source is not None, False, 1, 0)
        for c, s, m, source in rows
    ]
    utm = "utm struct<source: string, medium: string, campaign: string, content: string, term: string, id: string>"
    names = "client_id string, session_id string, start_ts timestamp, end_ts timestamp, " + utm
    return spark.createDataFrame(made, names + ", is_external boolean, no_client_id boolean, logged_in long, activated long")


def test_segments_of_a_long_path(spark):
    draw = random.Random(4)
    rows = [("hot", f"s{i:04}", draw.randint(0, 60 * 24 * 3), f"x{i}") for i in range(900)]
    rows += [("hot", f"t{i}", draw.randint(0, 60 * 24), None) for i in range(50)] + [("one", "u", 3, "y"), ("no", "v", 3, None)]
    found = visits(spark, *rows)
    paths: dict = {}
    for r in rollup.touchpoint_segments(found, size=64).orderBy("client_id", "segment").collect():
        steps = r.path.split(" > ")
        assert r.segment == len(paths.get(r.client_id, [])) // 64 and len(steps) == r.sessions <= 64
        paths.setdefault(r.client_id, []).extend(steps)
    want = [f"{x}/m:c" for _, _, x in sorted((m, s, x) for c, s, m, x in rows if c == "hot" and x)]
    assert paths == {"hot": want, "one": ["y/m:c"]}


def test_users_meet_states_not_sessions(spark):
    """Ten users of a client with 2,000 sessions: ten rows meet the client's one state."""
    found = visits(spark, *[("c", f"s{i}", i, "x") for i in range(2000)], ("d", "t", 5, "y"))
    seen = [("s0", "c", f"u{i}", False) for i in range(10)] + [("t", "d", "u3", False), ("gone", "e", "u9", True)]
    es = spark.createDataFrame(seen, "session_id string, client_id string, user_id string, no_client_id boolean")
    whose = rollup.owners(es, found)
    users = rollup.users(found, whose)
    totals = {r.user_id: r.sessions for r in users.collect()}
    assert totals == {f"u{i}": 2001 if i == 3 else 2000 for i in range(10)}
    assert rollup.user_map(whose, found).count() == 20002
    assert whose.by_client.count() == 11 and whose.by_session.count() == 1


def test_every_event_has_one_session(spark):
    rows = [
        {"timestamp": at(7 * i % 900), "hash": f"h{i % 3}", "client_id": f"c{i % 4}" if i % 5 == 0 else None,
         "url": NEWS if i % 11 == 0 else "https://example.com/", "event_name": "pageview" if i % 2 else "scroll"}
        for i in range(300)
    ]
    es = events_sessionated(events(spark, *rows), parameters=False)
    assert es.count() == 300 and es.select("event_id").distinct().count() == 300
    totals = sessions.session_rows(es).agg(F.sum("hits")).first()[0]
    assert totals == 300
    per = es.groupBy("session_id").agg(F.count_distinct("block_id").alias("n")).agg(F.max("n"))
    assert per.first()[0] == 1


def test_packed_ids_come_back(spark):
    digest = "ab" * 32
    texts = [digest, digest.upper(), digest[1:], "c1", "c12", "", "x", "é", "qrvM" * 10 + "qrs=", "A" * 44, "=" * 44]
    rows = spark.createDataFrame([(t, o) for t in [*texts, None] for o in (digest, "x", None)], "t string, o string")
    kept = rows.withColumns({"p": ids.packed(F.col("t")), "b": ids.packed_beside(F.col("t"), F.col("o"))})
    back = kept.select("t", "p", ids.unpacked(F.col("p")).alias("one"), ids.unpacked_beside(F.col("b"), F.col("o")).alias("two"))
    found = back.collect()
    assert all(row.t == row.one == row.two for row in found)
    assert len({bytes(row.p) for row in found if row.t is not None}) == len(texts)
    assert len(next(row.p for row in found if row.t == digest)) == 33


def test_a_value_holds_over_slices_and_instants(spark):
    values = spark.createDataFrame(
        [("a", 5, 1, "low"), ("a", 5, 2, "high"), ("a", 2 * SECOND, 0, "late"), (None, 1, 0, "none")],
        "k string, us long, rank int, value string",
    )
    times = [4, 5, 6, SECOND + 1, 2 * SECOND - 1, 2 * SECOND, 9 * SECOND]
    asked = spark.createDataFrame([("a", t) for t in times] + [("b", 5), (None, 5)], "k string, us long")
    for opens in (None, F.lit(0)):
        found = carry.in_force(asked, values, ["k"], 1, opens=opens)
        shown = {(r.k, r.us): r.value for r in found.collect()}
        assert shown == dict(zip([("a", t) for t in times], [None, *["high"] * 4, *["late"] * 2])) | {("b", 5): None}


def _exchanges(frame) -> int:
    """Shuffles in the plan of a frame, joins not broadcast."""
    spark = frame.sparkSession
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        spark.conf.set(key, before)


def test_lookback_moves_the_sessions_once(spark):
    """F5 to F24: sessions went to their client's instants and were joined again with what was found."""
    es = events_sessionated(events(spark, {"client_id": "a"}), parameters=False)
    rows = stage(sessions.session_rows(stage(es, "es")), "rows")
    assert _exchanges(sessions.sessions(es, rows=rows)) <= 5


def test_ids_move_packed(spark):
    """F5 to F24: hashes and session ids moved as text, twice as long."""
    es = stage(events_sessionated(events(spark, {"client_id": "a"}), parameters=False), "es")
    plan = sessions.session_rows(es)._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert keys and "unhex" in plan


def test_sessions_move_one_state_each_once(spark):
    es = stage(events_sessionated(events(spark, {}, {"user_agent": "other"}), parameters=False), "once")
    plan = sessions.session_rows(es)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_events_move_once_to_meet_their_facts(spark):
    """In one exchange, also where they are laid out by day, whatever the join thresholds."""
    rows = stage(
        events(spark, {}, {}, {"hash": None}, {"timestamp": at(24 * 60)}, {"client_id": "c"}), "wide"
    )
    facts = stage(visit_facts(rows), "facts")
    facts = facts.unionByName(facts)  # equal facts count once
    for days, shown in ((None, [0, 1, 3, 4]), ([at().date()], [0, 1, 4])):
        found = with_facts(rows, facts, days=days)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
        assert [r.event_id for r in found.orderBy("event_id").collect()] == shown
    assert {r.event_date for r in found.collect()} == {at().date()}


def test_staged_tables_are_written_small(spark, tmp_path):
    rows = spark.range(20000).select(ids.digest_id(F.col("id")).alias("id"))
    rows.write.option("compression", "snappy").parquet(str(tmp_path / "plain"))
    staged = stage(rows, "digests").inputFiles()
    size = sum(Path(f.removeprefix("file://")).stat().st_size for f in staged)
    assert size < 0.9 * sum(f.stat().st_size for f in (tmp_path / "plain").glob("*.parquet"))


def test_a_visit_s_facts_move_once_per_change(spark):
    """F7 to F22: every instant had a row of facts, and moved twice more to find its block."""
    rows = [{"timestamp": at(m)} for m in range(20)]
    rows += [{"timestamp": at(20), "url": "https://e.com/?utm_source=a"}, {"timestamp": at(21)}]
    rows += [{"timestamp": at(m), "client_id": "c"} for m in (5, 25)]
    rows += [{"timestamp": at(60 * h)} for h in (2, 13)]
    raw = stage(events(spark, *rows), "raw")
    facts = stage(visit_facts(raw), "facts")
    # two sources of the block, taken before and after by the visits with and without an id
    assert facts.count() < 10
    joined = with_facts(raw, facts).select("event_id", "block_start", "source.event_id")
    assert joined.count() == len(rows)
    whole = events_sessionated(raw, parameters=False)
    assert column(whole, "is_source_event")[20] and len(set(column(whole, "session_id")[:20])) <= 2


def test_activity_lies_by_slice(spark):
    """F7 to F22: activity was staged, then moved again for its slices and to meet its block."""
    raw = stage(events(spark, {"client_id": "a"}, {}), "raw")
    active = attribution.source_activity(raw)
    found = timeline.spans(timeline.moments(raw)).select("hash", "slice", "block_start")
    assert _exchanges(active) == 1
    assert _exchanges(active.join(stage(found, "spans"), ["hash", "slice"])) == 2


def test_a_carried_run_is_one_row(spark):
    asked = spark.createDataFrame([("a", t) for t in (1, 2, 3, 8, 9, 17)], "k string, us long")
    values = spark.createDataFrame([("a", 3, "x"), ("a", 9, "x")], "k string, us long, value string")
    asked, values = (f.withColumn("us", F.col("us") * SECOND) for f in (asked, values))
    found = carry.in_force(asked, values, ["k"], 8, runs=[])
    shown = sorted((r.us // SECOND, r.value) for r in found.collect())
    # a run ends with its slice
    assert shown == [(1, None), (3, "x"), (8, "x"), (17, "x")]


def test_only_sessions_that_take_a_source_move_to_their_donors(spark):
    """F7 to F22: external sessions moved with the rest, though they keep their own."""
    first = {"client_id": "a", "url": "https://e.com/?utm_source=x"}
    rows = events(spark, first, {"client_id": "a", "timestamp": at(60)}, {**first, "timestamp": at(120)})
    es = events_sessionated(rows, parameters=False)
    rows = stage(sessions.session_rows(stage(es, "es")), "rows")
    found = lookback.attribute(rows)
    assert found.columns == [*rows.columns, "donor_start_ts"]
    shown = [(r.utm.source, r.donor_start_ts) for r in found.orderBy("start_ts").collect()]
    assert shown == [("x", None), ("x", at(0)), ("x", None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Filter .*NOT is_external", plan)
