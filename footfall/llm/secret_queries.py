"""op6: secrets of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.llm.secret_scan import BASE, joined, scan_secrets
from footfall.llm.tables import table


def op6_secret_scan(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE),
        F.sha2(joined(of(*BASE)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.array_join(F.transform("spans", lambda s: s["n_owners"].cast("string")), ",").alias("owners"),
        F.array_join(F.transform("spans", lambda s: s["n_repos"].cast("string")), ",").alias("repos"),
    )


QUERIES = {"op6_secret_scan": op6_secret_scan}

ORACLES: dict[str, str] = {}
