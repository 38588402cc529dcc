"""op2: quality rules over all documents."""

from __future__ import annotations

from footfall.llm.quality_rules import judge_documents, train
from footfall.llm.tables import table


def op2_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    crf = train(docs, table(spark, sf_dir, "labels"))
    return judge_documents(docs.select("doc_id", "text"), crf).select("row.doc_id", "verdict.*")


QUERIES = {"op2_quality_rules": op2_quality_rules}

ORACLES: dict[str, str] = {}
