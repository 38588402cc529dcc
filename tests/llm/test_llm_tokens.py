"""Token counts and encoding against the libraries that define them."""

from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from llm_tables import documents
from tokenizers import Tokenizer

from footfall.llm import fst_tokens
from footfall.llm.byte_bpe import Codec, encode_texts
from footfall.llm.fst_tokens import Counter, count_tokens
from footfall.llm.token_queries import RANKS, VOCABULARY

PATTERN = public_tokenizers.PATTERN
PIECES = [
    " ", "  ", "\n", "\t", "a", "the", " the", "ing", "'s", "'", "1", "23", "!", "é", "ß", "日本",
    "　", "\xa0", "\x1c", "\x85", "<|endoftext|>", "²", "x" * 30, "_", "​", "😀", "İ", "-----",
]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def codec():
    return Codec(RANKS, PATTERN)


@pytest.fixture(scope="module")
def counter():
    return Counter(VOCABULARY, PATTERN)


def mixtures(n: int, longest: int, seed: int = 5):
    draw = random.Random(seed)
    for _ in range(n):
        yield "".join(draw.choices(PIECES, k=draw.randint(0, longest)))


def test_merges_of_many_ties(codec, reference):
    draw = random.Random(1)
    for letters in ("a", "ab", "aab ", "thein", "\x00\xff"):
        for n in (1, 2, 3, 50, 999):
            piece = "".join(draw.choices(letters, k=n)).encode()
            assert codec.merge(piece) == reference._encode_single_piece(piece)
            assert not any(codec.low)


def test_encoding_is_that_of_the_library(codec, reference):
    for text in mixtures(2000, 25):
        ids = codec.encode(text)
        assert memoryview(ids).cast("I").tolist() == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_counts_are_those_of_the_library(counter, library):
    for text in mixtures(2000, 25):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("size", [3, 7, 20])
def test_counts_do_not_depend_on_chunks(counter, library, monkeypatch, size):
    monkeypatch.setattr(fst_tokens, "CHUNK_CHARS", size)
    for text in mixtures(200, 60, seed=size):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_one_long_pre_token(codec, counter, reference):
    text = "".join(random.Random(2).choices("abcdefgh", k=60_000))
    ids = codec.encode(text)
    assert memoryview(ids).cast("I").tolist() == reference.encode_ordinary(text)
    assert counter.count(text) == len(ids) // 4


def test_little_memory_gives_the_same(counter, library, monkeypatch):
    monkeypatch.setattr(fst_tokens, "STATES", 50)
    monkeypatch.setattr(counter.words, "limit", 3)
    for text in mixtures(100, 20, seed=9):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_rows(spark, reference):
    docs, texts = documents(spark, "ids string, n_tokens string")
    rows = encode_texts(docs, RANKS, PATTERN).collect()
    assert len(rows) == len(texts)
    by_id = {(r.doc_id, bytes(r.decoded)): r for r in rows}
    for doc_id, text in texts:
        row = by_id[doc_id, (text or "").encode()]
        assert memoryview(bytes(row.ids)).cast("I").tolist() == reference.encode_ordinary(text or "")
    counted = {(r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(docs, VOCABULARY, PATTERN).collect()}
    assert counted == {
        (i, len((t or "").encode()), len(reference.encode_ordinary(t or ""))) for i, t in texts
    }


def test_empty_table(spark):
    docs = documents(spark)[0].limit(0)
    assert encode_texts(docs, RANKS, PATTERN).count() == 0
    assert count_tokens(docs, VOCABULARY, PATTERN).count() == 0


def test_queries_agree_with_the_library(spark, reference, sf_dir):
    from footfall.llm.token_queries import op5_token_counts, op10_byte_bpe

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    coded = op10_byte_bpe(spark, sf_dir).collect()
    assert len(coded) == len(texts)
    for row in coded:
        ids = reference.encode_ordinary(texts[row.doc_id])
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert row.ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
        assert row.n_tokens == len(ids)
    counts = {r.doc_id: r for r in op5_token_counts(spark, sf_dir).collect()}
    assert {i: r.n_tokens for i, r in counts.items()} == {r.doc_id: r.n_tokens for r in coded}
    assert all(r.over_limit == (r.n_tokens > 1024) for r in counts.values())
