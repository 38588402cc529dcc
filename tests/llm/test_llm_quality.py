"""Counting rules against a plain version; the CRF by its own definitions and by labels."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
from llm_tables import documents
from pyspark.sql import functions as F

from footfall.llm.quality_queries import op2_quality_rules
from footfall.llm.quality_rules import (
    DEFAULT, N_FEATURES, TRAIN_LINES, fit_crf, judge, judge_documents, keep_good, read_lines, train,
    train_lines, viterbi,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    words = WORD.findall(text)
    seen, n_dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            n_dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {
        i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)
    }
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    n_symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), n_symbols, n_dup, len(covered), failed


def test_counts_of_any_text():
    draw = random.Random(6)
    pieces = ["a", "b", "é", " ", "\n", "\x0b", "\x1c", "\xa0", "#", "İ", "a b c d e ", "\na b\n"]
    for _ in range(1500):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 40)))
        assert judge(text, DEFAULT)[:6] == counted(text)


def test_viterbi_is_the_best_sequence():
    draw = np.random.default_rng(7)
    for n in range(1, 8):
        scores, moves = draw.normal(size=n), draw.normal(size=(2, 2))
        value = lambda s: sum(scores[i] * s[i] for i in range(n)) + sum(  # noqa: B023, E731
            moves[a, b] for a, b in itertools.pairwise(s)  # noqa: B023
        )
        assert np.isclose(
            value(viterbi(scores, moves)), max(map(value, itertools.product((0, 1), repeat=n)))
        )


def test_fit_separates():
    draw = np.random.default_rng(8)
    made = []
    for i in range(60):
        lines = draw.random((draw.integers(1, 9), N_FEATURES)) * 0.1
        lines[:, 0] = 1
        lines[:, 1] += 0.5 * (i % 2)
        made.append((lines, 1 - i % 2))
    crf = fit_crf(made)
    assert all((viterbi(x @ crf.weights, crf.moves) == label).all() for x, label in made)
    assert fit_crf([]) is DEFAULT and fit_crf(made[:1]) is DEFAULT


def test_features_are_finite():
    for text in ("", "a", "!!!", "###", "A" * 50_000, "İ\n" * 50):
        assert np.isfinite(read_lines(text).features).all()


def test_rows(spark):
    docs, texts = documents(spark)
    rows = judge_documents(docs, DEFAULT).select("row.doc_id", "row.text", "verdict.*").collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = counted(row.text or "")
        assert (
            row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed
        ) == want
        assert not (row.base_failed and row.kept)
    assert keep_good(docs, DEFAULT).columns == docs.columns
    assert keep_good(docs.limit(0), DEFAULT).count() == 0


def test_training_without_labels(spark):
    docs, _ = documents(spark)
    labels = spark.createDataFrame([(99, None, 0)], "doc_id long, quality int, toxic int")
    assert train(docs, labels) is DEFAULT
    assert train(docs.limit(0), labels) is DEFAULT


def test_training_lines_come_from_anywhere():
    lines = np.arange(2.0 * TRAIN_LINES + 1).reshape(-1, 1)
    starts = {train_lines(lines, digest)[0, 0] for digest in range(-700, 700)}
    assert starts == set(range(TRAIN_LINES + 2))
    assert all(len(train_lines(lines, digest)) == TRAIN_LINES for digest in range(9))
    assert (train_lines(lines[:5], 3) == lines[:5]).all()


def test_training_takes_labelled_documents_only(spark):
    """Labels without a document take no place, and the order of the rows does not matter."""
    texts = ["plain words that go on and tell a story of some kind", "BUY $$$ NOW | | click # * &"]
    rows = [(i, f"{texts[i % 2]} {i}\n" * 3) for i in range(40)] * 2
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(4000)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fits = [train(part, labels, limit=20) for part in (docs, docs.orderBy(F.desc("doc_id")).repartition(7))]
    assert fits[0] is not DEFAULT
    assert all((a == b).all() for a, b in zip(*map(tuple, fits), strict=True))


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = op2_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = counted(texts[r.doc_id])
        assert (
            r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed
        ) == want
    judged = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels and not r.base_failed]
    good = [kept for kept, quality in judged if quality == 1]
    bad = [kept for kept, quality in judged if quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.2 * len(bad)
