"""URL rules against plain Python; mined rules against counting all token sets."""

from __future__ import annotations

import itertools
import random
import re

from pyspark.sql import functions as F

from footfall.llm.url_filter import Rule, filter_urls, matching, mine_rules, url_tokens
from footfall.llm.url_queries import RULES, labelled_urls, op8_url_filter

SCHEMA = "page_id long, url string, html string, verdict string, tokens string"
MINED = "rule string, tokens array<string>, rarest string, confidence double, support double"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, None, None, None) for i, u in enumerate(urls)], SCHEMA)


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def ruled(host, path):
    fits = [
        r for r in RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


URLS = [
    None, "", "no scheme", "://", "http://", "http://A.Example.ORG/es/x?y#z", "https://example.org/en/12",
    "x://example.org/en/2", "http://badexample.org/es/", "http://ÀB.com/de/", "http://com/de/1",
    "http://org", "http://a.org?/es/", "http://a.b.com/fr/://x", "http://u:p@h.com:80/de/\nq", "a://b://c/d",
    "http://x.com/fr", "http://EXAMPLE.org/ES/", "http://x.com/" + "a" * 50_000,
]


def test_explicit_rules(spark):
    none = spark.createDataFrame([], MINED)
    urls = URLS + URLS[5:7]
    rows = filter_urls(pages(spark, urls), none, RULES).orderBy("page_id").collect()
    assert len(rows) == len(urls)
    for url, row in zip(urls, rows, strict=True):
        rule = ruled(*parts(url))
        assert (row.host, row.path) == parts(url)
        assert row.rule == (rule.host + rule.path if rule else None)
        assert row.verdict == (rule.verdict if rule else "allow")
    assert filter_urls(pages(spark, []), none, RULES).count() == 0


def all_rules(rows, min_support, min_confidence, min_bad, min_deviations):
    """By counting all token sets: those that stand out, without what a part covers."""
    found, n = {}, len(rows)
    share = sum(bad for _, bad in rows) / n
    letters = sorted({t for tokens, _ in rows for t in tokens})
    for size in range(1, 6):
        for items in itertools.combinations(letters, size):
            has = [bad for tokens, bad in rows if set(items) <= set(tokens)]
            if sum(has) >= max(min_support * n, min_bad, 1) and sum(has) >= min_confidence * len(has):
                if sum(has) - share * len(has) >= min_deviations * (len(has) * share * (1 - share)) ** 0.5:
                    found[items] = (round(sum(has) / len(has), 9), round(sum(has) / n, 9))
    return {
        items: figures
        for items, figures in found.items()
        if not any(set(p) < set(items) and found[p][0] >= figures[0] for p in found)
    }


def test_rules_that_stand_out(spark):
    draw = random.Random(2)
    rows = []
    for _ in range(1500):
        tokens = sorted({draw.choice("abcdefgh") for _ in range(5)})
        chance = 0.97 if {"a", "b"} <= set(tokens) else 0.83 if "c" in tokens else 0.1
        rows.append((tokens, draw.random() < chance))
    labelled = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    for figures in ((0.02, 0.8, 10, 5.0), (0.005, 0.7, 10, 0.0), (0.005, 0.8, 100, 9.0)):
        mined = {
            tuple(r.tokens): (round(r.confidence, 9), round(r.support, 9))
            for r in mine_rules(labelled, *figures).collect()
        }
        assert mined == all_rules(rows, *figures)
        assert ("a", "b") in mined or figures[2] == 100


def test_labels_by_chance_give_no_rules(spark):
    draw = random.Random(3)
    rows = [
        (sorted({f"t{draw.randrange(40)}" for _ in range(6)}), draw.random() < 0.24) for _ in range(3000)
    ]
    assert mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).count() == 0


def test_mined_rules_are_all_rules(spark):
    draw = random.Random(1)
    rows = []
    for _ in range(400):
        tokens = sorted({draw.choice("abcdefg") for _ in range(4)})
        bad = {"a", "b"} <= set(tokens) or ("c" in tokens and draw.random() < 0.2)
        rows.append((tokens, bad))
    labelled = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    mined = {
        tuple(r.tokens): (round(r.confidence, 9), round(r.support, 9))
        for r in mine_rules(labelled, 0.02, 0.8, 0, 0.0).collect()
    }
    want = all_rules(rows, 0.02, 0.8, 0, 0.0)
    assert want and mined == want


def test_matching_needs_all_tokens(spark):
    mined = spark.createDataFrame(
        [("h:bad p:buy", ["h:bad", "p:buy"], "p:buy", 0.9, 0.1), ("q:x", ["q:x"], "q:x", 0.8, 0.1)], MINED
    )
    urls = ["http://bad.com/buy", "http://good.com/buy", "http://bad.com/", "http://good.com/?x=1"]
    found = {r.url for r in matching(pages(spark, urls * 2), mined).collect()}
    assert found == {urls[0], urls[3]}
    rows = filter_urls(pages(spark, urls * 2), mined, (Rule("allow", "bad.com", "/buy"),)).collect()
    assert sorted(r.verdict for r in rows) == ["allow"] * 6 + ["block"] * 2


def test_tokens(spark):
    row = pages(spark, ["http://WWW.a12.com/News/2024-01/x.html?Ref=3&b"]).select(
        url_tokens(F.col("url")).alias("t")
    ).first()
    assert row.t == ["h:www", "h:a#", "h:com", "p:news", "p:#", "p:x", "p:html", "q:Ref", "q:b"]


def test_no_labels(spark):
    labelled = spark.createDataFrame([], "tokens array<string>, bad boolean")
    assert mine_rules(labelled).count() == 0
    good = spark.createDataFrame([(["a"], False), ([], False), (None, True)], labelled.schema)
    assert mine_rules(good).count() == 0


def test_query(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op8_url_filter(spark, sf_dir).collect()
    assert len(rows) == len(urls)
    labelled = labelled_urls(spark, sf_dir).collect()
    for row in rows:
        host, path = parts(urls[row.page_id])
        rule = ruled(host, path)
        assert (row.host, row.path, row.rule) == (host, path, rule and rule.host + rule.path)
        mined = row.mined_rule is not None
        assert row.verdict == (rule.verdict if rule else "block" if mined else "allow")
        if mined:
            needs = set(row.mined_rule.split(" "))
            has = [r.bad for r in labelled if needs <= set(r.tokens)]
            assert sum(has) >= 0.8 * len(has)
