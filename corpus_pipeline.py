"""From raw documents to token ids: a pipeline of five corpus operators.

Each stage takes the session, the documents its predecessor kept and the folder of the
given tables, and returns a DataFrame.  ``run`` writes every stage's result as Parquet
below the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from footfall.llm.bagminhash import one_of_each
from footfall.llm.byte_bpe import encode_texts
from footfall.llm.decontaminate import without_leaks
from footfall.llm.quality_rules import keep_good, train
from footfall.llm.secret_scan import redact_secrets
from footfall.llm.tables import table
from footfall.sources.staging import new_folder, staging_run

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counting rules and the line labels keep."""
    crf = train(docs, table(spark, sf_dir, "labels"))
    return keep_good(docs, crf)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    return redact_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as little-endian unsigned 32-bit integers."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_texts(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: The line labels, signatures and merges of the stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark)
    for name, function in STAGES:
        path = f"{folder}/pipeline_{name}"
        # what a stage writes on its way goes when its result is written
        with staging_run(spark):
            function(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
