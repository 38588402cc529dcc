"""The pipeline against its stages done plainly on the driver."""

from __future__ import annotations

import base64

import corpus_pipeline
import public_tokenizers
import tiktoken
from llm_tables import documents
from test_llm_dedup import classes
from test_llm_leaks import shingles

import __spark_entry__ as entry
from footfall.llm.quality_rules import judge, train
from footfall.llm.secret_scan import find_spans
from footfall.llm.token_queries import RANKS


def test_registered():
    names = list(entry.queries())
    assert [n for n in names if n.startswith("op")] and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    owner = {r.doc_id: r.source for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    crf = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {i: t for i, t in sorted(texts.items()) if judge(t, crf)[6]}
    same = classes(kept.items())
    kept = {i: t for i, t in kept.items() if same[i] == i}
    needs = [n for n in map(shingles, items) if n]
    kept = {
        i: t for i, t in kept.items() if all(len(n & shingles(t)) < 0.8 * len(n) for n in needs)
    }
    spans = {i: find_spans(t) for i, t in kept.items()}
    owners: dict[str, set] = {}
    for i, found in spans.items():
        for *_, value in found:
            owners.setdefault(value, set()).add(owner[i])
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
    encoder = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    want = {}
    for i, text in kept.items():
        shown = [s for s in spans[i] if s[0] != "token" or len(owners[s[3]]) <= 2]
        out, at = "", 0
        for kind, start, end, _ in shown:
            if end > at:
                out += text[at : max(at, start)] + f"[{kind}]"
                at = end
        want[i] = encoder.encode_ordinary(out + text[at:])
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: memoryview(bytes(r.ids)).cast("I").tolist() for r in rows} == want
    assert 0 < len(rows) < len(texts)


def test_stages_keep_columns(spark, sf_dir):
    docs, _ = documents(spark, "verdict string, `a.b` string, _row long, _spans string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() > 0
