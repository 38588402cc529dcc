"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from footfall.llm import (
    chat_queries,
    dedup_queries,
    language_queries,
    leak_queries,
    negative_queries,
    quality_queries,
    run_queries,
    search_queries,
    secret_queries,
    suffix_queries,
    token_queries,
    url_queries,
)

MODULES = (
    chat_queries,
    dedup_queries,
    language_queries,
    leak_queries,
    negative_queries,
    quality_queries,
    run_queries,
    search_queries,
    secret_queries,
    suffix_queries,
    token_queries,
    url_queries,
)

QUERIES = {name: run for module in MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
