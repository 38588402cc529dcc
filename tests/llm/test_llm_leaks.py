"""Benchmark items inside documents, against plain sets of shingles."""

from __future__ import annotations

import random

from compare import compare, connect
from llm_tables import documents

from footfall.llm import decontaminate
from footfall.llm.decontaminate import candidates, find_leaks, probe_index, without_leaks
from footfall.llm.leak_queries import ORACLES, op9_decontamination


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def made(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choices("abcdef", k=4))
    items = [(i, " ".join(word() for _ in range(draw.choice((3, 5, 6, 9, 17, 40, 90))))) for i in range(40)]
    more = []
    for i in range(100, 220):
        words = [word() for _ in range(draw.randint(0, 60))]
        for _, item in draw.sample(items, 2):
            own = item.split()
            for _ in range(draw.choice((0, 0, 1, 2))):
                own[draw.randrange(len(own))] = word()
            at = draw.randint(0, len(words))
            words[at:at] = own
        more.append((i, "  ".join(words).title()))
    more += [more[0]] * 3
    rows = [(i, t, None) for i, t in [*items, (50, None), (51, ""), (None, items[5][1]), items[4]]]
    benchmark = spark.createDataFrame(rows, "item_id long, text string, doc_id long")
    docs, texts = documents(spark, "item_id long, shingle string, _row long", more)
    return docs, texts, benchmark, [(i, t) for i, t, _ in rows]


def leaks(texts, items):
    found = set()
    for i, text in texts:
        own = shingles(text)
        for item, wanted in items:
            needs = shingles(wanted)
            if needs and len(needs & own) >= 0.8 * len(needs):
                found.add((i, item, len(needs & own), len(needs)))
    return found


def test_all_leaks(spark):
    docs, texts, benchmark, items = made(spark)
    got = {(r.doc_id, r.item_id, r.n_matched, r.n_shingles) for r in find_leaks(docs, benchmark).collect()}
    assert got == leaks(texts, items) and len(got) > 40


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs, texts, benchmark, items = made(spark)
    assert find_leaks(docs, benchmark).count() == len(leaks(texts, items))


def test_probes_cannot_be_avoided(spark):
    _, _, benchmark, items = made(spark)
    for row in probe_index(benchmark).groupBy("item_id").agg(
        {"n_shingles": "max", "probe": "count"}
    ).collect():
        assert row["max(n_shingles)"] == row["count(probe)"]
    probes = probe_index(benchmark).filter("probe").groupBy("item_id", "n_shingles").count().collect()
    # a document with 80 % of the shingles can miss at most the rest
    assert all(r["count"] > r.n_shingles - -(-r.n_shingles * 4 // 5) for r in probes)


def test_only_probes_propose(spark):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(24))) for i in range(20)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    index = probe_index(benchmark)
    rows = index.collect()
    plain = [(r.item_id, r.shingle) for r in rows if not r.probe]
    hits = spark.createDataFrame(plain, "doc_id long, shingle long")
    assert plain and candidates(hits, index).count() == 0
    one = {r.item_id: (r.item_id, r.shingle) for r in rows if r.probe}
    hits = spark.createDataFrame([*plain, *one.values()], hits.schema)
    assert {tuple(r) for r in candidates(hits, index).collect()} == {(i, i) for i, _ in items}


def test_shared_passage(spark):
    """A passage that half the documents and all items hold proposes no false leak."""
    shared = " ".join(f"s{k}" for k in range(12))
    items = [(i, shared + " " + " ".join(f"i{i}w{k}" for k in range(20))) for i in range(30)]
    texts = [(i, shared + f" d{i} e{i} f{i} g{i} h{i}" if i % 2 else f"a{i} " * 9) for i in range(200)]
    texts += [(1000 + i, "before " + items[i][1] + " after") for i in range(3)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_matched, r.n_shingles) for r in find_leaks(docs, benchmark).collect()}
    assert got == leaks(texts, items) == {(1000 + i, i, 28, 28) for i in range(3)}


def test_removal(spark):
    docs, texts, benchmark, items = made(spark)
    kept = without_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    bad = {i for i, *_ in leaks(texts, items)}
    want = sorted(i or 0 for i, _ in texts if i not in bad)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == want
    assert without_leaks(docs.limit(0), benchmark).count() == 0
    assert without_leaks(docs, benchmark.limit(0)).count() == len(texts)


def test_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows, problems = compare(
        op9_decontamination(spark, sf_dir), connect(sf_dir), ORACLES["op9_decontamination"]
    )
    assert rows > 0 and not problems


def test_no_python_on_executors(spark, sf_dir):
    plan = op9_decontamination(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
