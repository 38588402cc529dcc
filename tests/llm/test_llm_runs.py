"""Periodic runs against a comparison of all shifts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from llm_tables import documents

from footfall.llm import periodic_runs
from footfall.llm.periodic_runs import collapse_runs, find_runs, stretches, window_min
from footfall.llm.run_queries import op12_periodic_runs


def brute(words) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, from the maximal stretches of every shift."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((b, e - b, q) for (b, e), q in found.items())


def collapsed(words, runs) -> str:
    gone = {i for b, size, q in runs for i in range(b + q, b + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def fibonacci(n: int) -> str:
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def made(draw: random.Random) -> list[str]:
    """A text with nested, touching and broken repetitions."""
    letters = draw.choice(["ab", "abc", "abcdefghijklmnop"])
    text: list[str] = []
    for _ in range(draw.randint(1, 4)):
        text += draw.choices(letters, k=draw.randint(0, 30))
        root = draw.choices(letters, k=draw.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 60, 64, 100]))
        if draw.random() < 0.4:
            root = root[: len(root) // 5 + 1] * draw.randint(3, 12) + draw.choices(letters, k=draw.randint(1, 9))
        again = root * draw.randint(2, 6)
        text += again[: len(again) - draw.randint(0, len(root))]
        if text and draw.random() < 0.3:
            text[draw.randrange(len(text))] = "x"
    return text


def test_helpers():
    draw = np.random.default_rng(3)
    x = draw.integers(0, 90, 200)
    for width in (1, 2, 8, 64):
        assert window_min(x, width).tolist() == [min(x[i : i + width]) for i in range(201 - width)]
    first, last = stretches(np.array([1, 0, 1, 1, 0, 0, 1], bool))
    assert first.tolist() == [0, 2, 6] and last.tolist() == [1, 4, 7]


def test_all_runs_are_found():
    draw = random.Random(5)
    texts = [made(draw) for _ in range(400)]
    texts += [list(fibonacci(n)) for n in (24, 300, 900)]
    texts += [list(fibonacci(50)) * 7, ["a"] * 700, (["a"] * 50 + ["b"]) * 5, [], ["a"], ["a"] * 23, ["a"] * 24]
    thue = ["ab"[bin(i).count("1") % 2] for i in range(512)]
    texts += [thue, thue * 3, (["a"] * 97 + ["b"] + ["a"] * 97 + ["c"]) * 3]
    sizes = np.array([len(t) for t in texts])
    number = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
    words = np.concatenate([np.array([*(number[w] for w in t), 1000 + k]) for k, t in enumerate(texts)])
    starts = np.cumsum(sizes + 1) - sizes - 1
    found = [[] for _ in texts]
    for b, e, q in find_runs(words, sizes).tolist():
        k = int(np.searchsorted(starts, b, "right")) - 1
        found[k].append((b - starts[k], e - b, q))
    want = [brute(t) for t in texts]
    assert found == want
    assert sum(map(len, want)) > 300 and max(q for runs in want for _, _, q in runs) >= 100


@pytest.mark.parametrize("batch", [1, 100, 1 << 19])
def test_texts(spark, monkeypatch, batch):
    monkeypatch.setattr(periodic_runs, "BATCH_WORDS", batch)
    draw = random.Random(batch)
    more = [(100 + i, draw.choice([" ", "\n", " \t "]).join(made(draw))) for i in range(60)]
    docs, texts = documents(spark, "runs string, collapsed string, n_words int", more)
    docs = docs.filter("doc_id IS NULL OR doc_id != 5")
    texts = [r for r in texts if r[0] != 5]
    want = []
    for i, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = brute(words)
        want.append((i, len(words), runs, collapsed(words, runs)))
    rows = collapse_runs(docs).collect()
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert collapse_runs(docs.limit(0)).count() == 0


def test_long_text(spark):
    text = "one two three " * 200_000 + " ".join(map(str, range(70_000))) * 3
    row = collapse_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    # the last word of one stretch and the first of the next are joined
    assert [tuple(r) for r in row.runs] == [(0, 600_000, 3)] and row.n_words == 809_998
    text = " ".join(map(str, range(70_000))) + " "
    row = collapse_runs(spark.createDataFrame([(1, text * 4)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, 280_000, 70_000)] and row.collapsed == text[:-1]


def test_query(spark, sf_dir):
    want = {}
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", row.text or "")
        n, h = len(words), zlib.crc32(str(row.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        lines = "".join(f"{b},{size},{q}\n" for b, size, q in runs)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        milli = math.floor(Fraction(1000 * best[1], best[2])) if best else None
        want[row.doc_id] = (len(runs), *(best or (None,) * 3), milli, digest(lines), digest(collapsed(words, runs)))
    got = {r[0]: tuple(r)[1:] for r in op12_periodic_runs(spark, sf_dir).collect()}
    assert got == want and sum(bool(v[0]) for v in want.values()) > 5
