"""op9: benchmark items inside all documents."""

from __future__ import annotations

from footfall.llm.decontaminate import find_leaks
from footfall.llm.tables import table


def op9_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontamination": op9_decontamination}

_SHINGLES = """
    SELECT DISTINCT {id}, array_to_string(words[i:i + 4], ' ') AS shingle
    FROM (SELECT {id}, words, unnest(range(1, len(words) - 3)) AS i
        FROM (SELECT {id}, [w FOR w IN regexp_split_to_array(lower(text), '[ \\t-\\r]+') IF w <> '']
            AS words FROM {table})
        WHERE len(words) >= 5)
"""

ORACLES = {
    "op9_decontamination": f"""
WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}),
b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id),
met AS (SELECT doc_id, item_id, count(*) AS n_matched FROM d JOIN b USING (shingle)
    GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_matched, n_shingles, n_matched / n_shingles AS containment
FROM met JOIN sizes USING (item_id) WHERE n_matched / n_shingles >= 0.8
""",
}
