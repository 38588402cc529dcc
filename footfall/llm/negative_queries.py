"""op13: hard negatives among all embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.llm.hard_negatives import hard_negatives, whole_numbers
from footfall.llm.tables import table
from footfall.llm.vectors import finite

#: Components are counted in 256ths; one row in 50 is an anchor.
SCALE, EVERY = 256, 50
#: Rows whose label is moved on by one, of ten labels.
MOVED, LABELS = 7, 10


def op13_hard_negatives(spark, sf_dir):
    given = table(spark, sf_dir, "embeddings").filter(finite(F.col("embedding")))
    label, number = F.col("label"), F.col("vec_id")
    moved = F.when(number % MOVED == 0, (label + 1) % LABELS).otherwise(label)
    rows = given.select(
        number.alias("id"), moved.alias("label"), whole_numbers(F.col("embedding"), SCALE).alias("vector")
    )
    return hard_negatives(rows, F.col("id") % EVERY == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}

ORACLES = {
    "op13_hard_negatives": """
WITH rows AS (
    SELECT vec_id AS id,
        CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS vector
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
),
scored AS (
    SELECT a.id AS anchor_id, a.label = r.label AS same, r.id,
        CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.vector, r.vector)]) AS BIGINT) AS score
    FROM rows a, rows r
    WHERE a.id % 50 = 0 AND a.id <> r.id
),
positives AS (
    SELECT * FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
),
ranked AS (
    SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id,
        p.score AS positive_score, n.score AS negative_score,
        CAST(row_number() OVER (
            PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id
        ) AS INTEGER) AS rank
    FROM positives p
    JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
        AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 3
"""
}
