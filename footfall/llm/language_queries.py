"""op4: languages of all documents, learned from three quarters of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.llm.language_id import fit, predict
from footfall.llm.tables import table


def op4_language_id(spark, sf_dir):
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "text", "lang"
    )
    model = fit(docs.filter(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model)


QUERIES = {"op4_language_id": op4_language_id}

ORACLES: dict[str, str] = {}
