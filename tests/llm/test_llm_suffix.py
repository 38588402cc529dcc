"""Repeated strings against a dictionary of all strings."""

from __future__ import annotations

import random

import numpy as np
import pytest
from llm_tables import documents

from footfall.llm import suffix_dedup
from footfall.llm.suffix_dedup import MARKS, NAMES, merged, packed, remove_repeats, sliding_min, unpacked
from footfall.llm.suffix_queries import op7_suffix_dedup

LENGTH = suffix_dedup.LENGTH


def cut(rows) -> dict:
    seen, out = {}, {}
    for i, text in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - LENGTH + 1):
            if data[p : p + LENGTH] in seen:
                gone[p : p + LENGTH] = True
            seen[data[p : p + LENGTH]] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[i] = (len(data), int(gone.sum()), spans, kept)
    return out


def test_helpers():
    draw = np.random.default_rng(1)
    x = draw.integers(0, 50, 300)
    for width in (1, 2, 3, 64, 69):
        assert sliding_min(x, width).tolist() == [min(x[i : i + width]) for i in range(301 - width)]
    rows = np.zeros(200, MARKS)
    rows["doc"], rows["start"] = draw.integers(-3, 3, 200), draw.integers(0, 900, 200)
    rows["end"] = rows["start"] + draw.integers(1, 20, 200)
    assert (unpacked(packed(rows), MARKS) == rows).all()
    assert len(unpacked(packed(np.zeros(0, NAMES)), NAMES)) == 0
    cover = lambda m: {(d, p) for d, s, e in m.tolist() for p in range(s, e)}
    once = merged(rows)
    assert cover(once) == cover(rows) and len(merged(once)) == len(once)


@pytest.mark.parametrize("buckets", [1, 7])
def test_made_cases(spark, buckets):
    draw = random.Random(buckets)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(14)[:LENGTH], text(16)[: LENGTH + 1], text(40), text(30)[: LENGTH - 1], "é" * 50, "ab" * 90]
    more = []
    for i in range(100, 180):
        parts = [text(draw.randint(0, 30))]
        for _ in range(draw.randint(0, 4)):
            parts += [draw.choice(shared), text(draw.randint(0, 12))]
        more.append((i, "".join(parts)))
    more += [(300 + i, more[3][1]) for i in range(30)]
    docs, texts = documents(spark, "bucket long, marks string, kept string", more)
    small = docs.filter("doc_id IS NULL OR doc_id NOT IN (5, 6)")
    want = cut([r for r in texts if r[0] not in (5, 6)])
    rows = remove_repeats(small, buckets).collect()
    assert len(rows) == len(texts) - 2
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows} == want
    assert any(v[1] == LENGTH for v in want.values())


def test_long_texts_of_one_period(spark):
    docs, texts = documents(spark)
    rows = {r.doc_id: r for r in remove_repeats(docs.filter("doc_id IN (5, 6)"), 3).collect()}
    period = len("Lorem ipsum dolor sit amet, consectetur adipiscing elit. ")
    # all strings but those that start in the first period are repeats
    assert rows[5].n_removed == rows[5].n_bytes - period and rows[5].n_spans == 1
    assert rows[6].n_removed == 99_999 and bytes(rows[6].kept) == b"x"


def test_repeat_far_into_a_long_text(spark):
    draw = np.random.default_rng(5)
    letters = lambda n: draw.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    passage = letters(400)
    long = letters((1 << suffix_dedup.PLACE_BITS) + 1000) + passage + letters(1000)
    rows = [(1, long), (2, letters(200) + passage + letters(200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in remove_repeats(docs, 2).select("doc_id", "n_bytes", "n_removed").collect()}
    assert [(got[i].n_bytes, got[i].n_removed) for i in (1, 2)] == [(len(long), 0), (800, 400)]


def test_windows_hold_each_string_once():
    size, step = suffix_dedup.BATCH_BYTES, suffix_dedup.BATCH_BYTES - (LENGTH - 1)
    for n in (0, LENGTH, size - 1, size, size + 1, size + step, size + step + 1):
        found = list(suffix_dedup.windows(bytes(n)))
        assert all(len(piece) <= size for _, piece in found)
        starts = [(at, at + max(len(piece) - LENGTH + 1, 0)) for at, piece in found]
        assert starts[0][0] == 0 and starts[-1][1] == max(n - LENGTH + 1, 0)
        assert all(a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False))


def test_empty_table(spark):
    assert remove_repeats(documents(spark)[0].limit(0), 3).count() == 0


def test_query(spark, sf_dir):
    import hashlib

    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for i, v in cut(texts).items()}
    rows = op7_suffix_dedup(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want
