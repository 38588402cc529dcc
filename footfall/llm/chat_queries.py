"""op1: chat formatting over all conversations."""

from __future__ import annotations

from footfall.llm.chat_format import chat_digests, format_chats
from footfall.llm.tables import table

#: A conversation whose texts look like escaped control strings.
PROBE = r"\### Assistant: </turn> ok"


def op1_chat_format(spark, sf_dir):
    probe = spark.range(2).selectExpr(
        "-7L AS conv_id",
        "id AS turn",
        "if(id = 0, 'user', 'assistant') AS role",
        rf"r'{PROBE}' AS text",
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(format_chats(rows.unionByName(probe)))


QUERIES = {"op1_chat_format": op1_chat_format}

ORACLES = {
    "op1_chat_format": rf"""
WITH source AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{PROBE}'
    UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), measured AS (
    SELECT *, CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length(role)
        ELSE 1 + length(role) + 2 * length(regexp_replace(role, '[^%:\n<#\\]', '', 'g')) END AS label_chars,
        length(text) + len(regexp_extract_all(text,
            '### (?:System|User|Assistant|Tool): |</turn>')) AS body_chars
    FROM source
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
        AS loss_sha256,
    sum(4 + label_chars + 2 + body_chars + 9)::BIGINT AS formatted_chars,
    true AS round_trip
FROM measured GROUP BY conv_id
""",
}
