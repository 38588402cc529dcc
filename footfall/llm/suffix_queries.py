"""op7: repeated 100-byte strings taken out of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.llm.suffix_dedup import remove_repeats
from footfall.llm.tables import table


def op7_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}

ORACLES: dict[str, str] = {}
