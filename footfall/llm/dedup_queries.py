"""op3: near-duplicates among all documents."""

from __future__ import annotations

from footfall.llm.bagminhash import near_duplicates
from footfall.llm.tables import table


def op3_bagminhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_bagminhash": op3_bagminhash}

ORACLES: dict[str, str] = {}
