"""Secret spans against plain regular expressions, and ownership by counting."""

from __future__ import annotations

import hashlib
import random
import re

from llm_tables import documents
from pyspark.sql import functions as F

from footfall.llm.secret_queries import op6_secret_scan
from footfall.llm.secret_scan import find_spans, ownership, redact_secrets, scan, scan_secrets

ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)


def base(text):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_spans_of_any_text():
    draw = random.Random(1)
    pieces = [
        "password", "Token", "API_KEY", "apikey", "secret", "ſecret", "toKen", ":", "=", " ", '"', "'",
        "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "x", "é", "\n", "Ab3", "- ", "_",
    ]
    for _ in range(4000):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 14)))
        got = [s[:3] for s in find_spans(text) if s[0] != "token"]
        assert got == base(text)
        assert all(text[a:b].endswith(v) for _, a, b, v in find_spans(text))


LIVE, COPIED = "zX81-qLw93kd0PmVb27Ty", "ExAmple0123456789KeyAbc"


def owned(spark):
    more = [(50, f"use {LIVE} here ☃"), (51, f"é {LIVE}.")]
    more += [(60 + i, f"docs say {COPIED} and password = {COPIED}") for i in range(6)]
    docs, texts = documents(spark, "row long, id string, spans string", more)
    source = F.when(F.col("doc_id") >= 60, F.concat(F.lit("s"), "doc_id")).otherwise(F.col("source"))
    return docs.withColumn("source", source), texts


def test_ownership(spark):
    docs, texts = owned(spark)
    values = {(r.n_owners, r.n_repos) for r in ownership(scan(docs)).collect()}
    assert values == {(1, 2), (6, 6)}
    rows = scan_secrets(docs).collect()
    assert len(rows) == len(texts)
    spans = {r.doc_id: [(s.kind, s.start, s.end, s.live) for s in r.spans] for r in rows}
    assert spans[50] == [("token", 4, 4 + len(LIVE), True)]
    assert spans[51] == [("token", 2, 2 + len(LIVE), True)]
    start = len(f"docs say {COPIED} and ")
    assert spans[60] == [("assign", start, start + 11 + len(COPIED), False)]
    assert not any(spans[i] for i in spans if i is None or i < 50)


def test_each_count_decides(spark):
    """A value of many owners is no live one, nor is one all over a single owner's texts."""
    held = {"few": (1, 4), "by_owners": (3, 1), "by_repos": (1, 21), "spread": (2, 10), "over": (2, 11)}
    rows = []
    for name, (n_owners, each) in held.items():
        value = f"{name}-Qz81wLx93kd0PmVb27Ty"
        rows += [(f"{name}{o}", f"see {value}") for o in range(n_owners) for _ in range(each)]
    rows = [(i, *row) for i, row in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = {}
    for row in scan_secrets(docs).collect():
        name = rows[row.doc_id][2].split("-")[0].removeprefix("see ")
        found.setdefault(name, set()).add(len(row.spans))
        assert all((s.n_owners, s.n_repos) == (held[name][0], held[name][0] * held[name][1]) for s in row.spans)
    assert found == {"few": {1}, "by_owners": {0}, "by_repos": {0}, "spread": {1}, "over": {0}}


def test_redaction(spark):
    docs, texts = owned(spark)
    clean = redact_secrets(docs)
    assert clean.columns == docs.columns
    rows = clean.collect()
    assert len(rows) == len(texts)
    text = {r.doc_id: r.text for r in rows}
    assert text[50] == "use [token] here ☃" and text[60] == f"docs say {COPIED} and [assign]"
    assert text[1] is None and text[5] == dict(texts)[5]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    assert redact_secrets(docs.limit(0)).count() == 0
    assert scan_secrets(docs.limit(0)).count() == 0


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op6_secret_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    assert sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 0
    for r in rows:
        spans = base(texts[r.doc_id])
        kinds = [s[0] for s in spans]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(kinds.count, ("assign", "access", "hex")))
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert set(filter(None, shown.split(","))) <= set(r.spans.split(","))
