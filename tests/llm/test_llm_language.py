"""Kneser-Ney models: proper distributions, held-out accuracy, odd rows."""

from __future__ import annotations

import random
from collections import Counter
from zlib import crc32

import numpy as np
from llm_tables import documents

from footfall.llm.language_id import SYMBOLS, Scorer, _kneser_ney, build_model, fit, predict, read_words
from footfall.llm.language_queries import op4_language_id


def counts(words):
    keys, n = np.unique(read_words(words).keys, return_counts=True)
    return keys, n


def test_probabilities_sum_to_one():
    draw = random.Random(1)
    words = ["".join(draw.choices("abcdé", k=draw.randint(1, 6))) for _ in range(300)]
    keys, n = counts(words)
    log_p, back_off, log_p2 = _kneser_ney(keys, n)
    assert np.allclose(np.exp(log_p2).reshape(SYMBOLS, SYMBOLS).sum(axis=1), 1)
    for context in np.unique(keys // SYMBOLS):
        every = back_off[context] + log_p2.reshape(SYMBOLS, SYMBOLS)[context % SYMBOLS]
        own = keys // SYMBOLS == context
        every[keys[own] % SYMBOLS] = log_p[own]
        assert np.isclose(np.exp(every).sum(), 1)


def test_trigrams_of_words():
    found = Counter(read_words(["ab", "c-d", "12", ""]).keys.tolist())
    of = lambda *codes: (codes[0] * SYMBOLS + codes[1]) * SYMBOLS + codes[2]
    want = [(0, 0, 1), (0, 1, 2), (1, 2, 0), (0, 0, 3), (0, 3, 0), (0, 0, 4), (0, 4, 0)]
    assert found == Counter(of(*w) for w in want)


def test_words_are_scored_the_same_in_any_batch():
    names = np.array(["x"] * 3 + ["y"] * 2)
    keys = np.array([5, 70_000, 1_000_000, 5, 9])
    scorer = Scorer(build_model(names, keys, np.array([3, 1, 2, 2, 2])))
    texts = ["ab cd", "ab", "", "cd ab ab", "12"]
    together = scorer.judge(texts)
    scorer.reset()
    assert together == [scorer.judge([t])[0] for t in texts]
    assert together[2] == together[4] == ("und", 0.0, True)


def test_rows(spark):
    more = [(100 + i, "der die das und nicht") for i in range(3)]
    docs, texts = documents(spark, "lang_pred string, score string", more)
    rows = predict(docs.select("doc_id", "text"), fit(docs)).collect()
    assert len(rows) == len(texts)
    letters = {i: any(c.isalpha() for c in t or "") for i, t in texts}
    assert all((r.lang_pred != "und") == letters[r.doc_id] for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    empty = docs.limit(0)
    assert fit(empty) is None and fit(docs.filter("lang IS NULL AND text IS NULL")) is None
    assert {r.lang_pred for r in predict(docs.select("doc_id", "text"), None).collect()} == {"und"}
    assert predict(empty.select("doc_id", "text"), None).count() == 0


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op4_language_id(spark, sf_dir).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert len(held) > 100 and sum(held) >= 0.98 * len(held)
