"""Near-duplicates against brute force; signatures against the exact similarity."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from llm_tables import documents
from pyspark.sql import functions as F

from footfall.llm import bagminhash
from footfall.llm.bagminhash import bag_of, bags, near_duplicates, one_of_each, overlap, signatures
from footfall.llm.dedup_queries import op3_bagminhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def bag(text: bytes) -> Counter:
    words = WORD.findall(text)
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def classes(rows) -> dict:
    """Smallest id of each component of pairs at 0.8 or more, from all pairs."""
    found = [(i, bag((t or "").encode())) for i, t in rows]
    parent = {i: i for i, _ in found}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(found):
        size = sum(a.values())
        for j, b in found[:n]:
            other = sum(b.values())
            if a and b and min(size, other) >= 0.8 * max(size, other) and root(i) != root(j):
                if similarity(a, b) >= 0.8:
                    low, high = sorted((root(i), root(j)))
                    parent[high] = low
    return {i: root(i) for i, _ in found}


def test_bags_and_overlap():
    draw = random.Random(1)
    texts = [" ".join(draw.choices("abc", k=draw.randint(0, 30))).encode() for _ in range(200)]
    owner, run, weight = bags(texts)
    for i, text in enumerate(texts):
        assert sorted(weight[owner == i].tolist()) == sorted(bag(text).values())
        assert bag_of(text) == bag(text)
    for i in range(0, 199, 2):
        if texts[i] and texts[i + 1]:
            assert overlap(bag_of(texts[i]), bag_of(texts[i + 1])) == similarity(bag(texts[i]), bag(texts[i + 1]))


def test_signatures_are_unbiased_with_weights():
    draw = random.Random(2)
    texts = []
    for k in range(400):
        # words of their own for each pair, so that the pairs' errors are independent
        words = [f"{w}{k}" for w in "abcdefgh" for _ in range(draw.choice((1, 5, 9, 40)))]
        texts += [" ".join(words).encode(), " ".join(words[: draw.randint(8, len(words))]).encode()]
    owner, run, weight = bags(texts)
    names = signatures(len(texts), owner, run, weight)
    exact = np.array([similarity(bag(a), bag(b)) for a, b in zip(texts[::2], texts[1::2], strict=True)])
    shared = (names[::2] == names[1::2]).mean(axis=1)
    assert abs((shared - exact).mean()) < 0.006
    assert np.abs(shared - exact).max() < 0.25


def test_chains_and_large_groups(spark):
    draw = random.Random(3)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    chain = []
    for step in range(12):  # neighbours are similar, the ends are not
        chain.append((100 + step, " ".join(base[step * 4 : step * 4 + 60])))
    group = [" ".join([*base[:100], f"own{i}"]) for i in range(80)]
    rows = chain + [(1000 + i, t) for i, t in enumerate(group)] + [(5000 + i, group[0]) for i in range(60)]
    docs, texts = documents(spark, "class_id string, d1 long, bands string", rows)
    got = {(r.doc_id, r.class_id) for r in near_duplicates(docs).collect()}
    want = classes([(i, t) for i, t in texts if i is not None])
    assert got == set(want.items()) | {(None, None)}


def test_pairs_among_texts_that_share_a_passage(spark):
    draw = random.Random(4)
    words = lambda n: [f"w{draw.randrange(10**12)}" for _ in range(n)]
    rows, want = [], {}
    for _ in range(12):
        passage = words(44)  # 40 runs; a word after it is a run more
        for own in draw.sample([1] * 2 + [11] * 500, 502):
            rows.append((len(rows), " ".join(passage + words(own))))
            short = own == 1  # two of them are similar by 40/42, all others by 40/52 at most
            want[rows[-1][0]] = (passage[0], "short" if short else rows[-1][0])
    lowest = {}
    for i, group in want.items():
        lowest.setdefault(group, i)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert got == {i: lowest[group] for i, group in want.items()}


def test_no_pair_of_a_full_band_is_left_out(spark):
    """All texts share all bands; each is similar to one other."""
    draw = random.Random(5)
    passages = [[f"w{draw.randrange(10**12)}" for _ in range(60)] for _ in range(300)]
    rows = [(i, " ".join([*passages[i % 300], f"own{i}"])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    nodes = bagminhash._nodes(bagminhash.sign(docs))
    full = F.sequence(F.lit(1).cast("long"), F.lit(bagminhash.BANDS).cast("long"))
    labels = bagminhash.near_labels(docs, nodes.withColumn("bands", full))
    found = nodes.join(labels, "node").groupBy("label").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    assert sorted(r.ids for r in found.collect()) == [[i, i + 300] for i in range(300)]


def test_made_words_are_told_apart(spark):
    """Words whose sums of powers are equal whatever the base, modulo a power of two."""
    rows = []
    for n in (1024, 4096):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        rows += [(len(rows), word), (len(rows) + 1, word.translate(str.maketrans("ab", "ba")))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i for i in range(4)}


def test_one_of_each(spark):
    docs, texts = documents(spark, "_row long, class_id string")
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    rows = kept.select("doc_id", "text").collect()
    assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert one_of_each(docs.limit(0)).count() == 0
    assert near_duplicates(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op3_bagminhash(spark, sf_dir).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == classes(sorted(rows))
