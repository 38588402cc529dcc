"""op11: the 20 nearest of all embeddings for every twentieth."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.llm.graph_search import nearest_rows
from footfall.llm.tables import table

EVERY, NEAREST = 20, 20


def op11_graph_search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = nearest_rows(rows, rows.filter(F.col("vec_id") % EVERY == 0), NEAREST)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


QUERIES = {"op11_graph_search": op11_graph_search}

ORACLES: dict[str, str] = {}
