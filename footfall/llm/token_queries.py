"""op5 and op10: token counts, encoding and decoding of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from footfall.llm.byte_bpe import encode_texts
from footfall.llm.fst_tokens import count_tokens
from footfall.llm.tables import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Tokens beyond which a text does not fit one training example.
TOKEN_LIMIT = 1024


def op5_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counted = count_tokens(docs, VOCABULARY, public_tokenizers.PATTERN)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    coded = encode_texts(docs, RANKS, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op5_token_counts": op5_token_counts, "op10_byte_bpe": op10_byte_bpe}

ORACLES: dict[str, str] = {}
