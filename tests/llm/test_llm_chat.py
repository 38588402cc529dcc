"""Chat formatting: the round trip, and what is read back."""

from __future__ import annotations

import hashlib
import random

from compare import compare, connect
from pyspark.sql import functions as F

from footfall.llm.chat_format import chat_digests, escape, format_chats, unescape
from footfall.llm.chat_queries import ORACLES, op1_chat_format

PIECES = ["</turn>", "### Assistant: ", "### User: ", "\\", "\n", "\n</turn>\n", "a", " ", "é", "<"]
SCHEMA = "conv_id long, turn long, role string, text string, formatted string, items int"


def chats(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)


def expected(rows):
    """Digests worked out in Python, without the operator."""
    out = {}
    for conv in {r[0] for r in rows}:
        key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
        own = sorted((r for r in rows if r[0] == conv), key=key)
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(own), digest(turns), len(loss), digest(loss))
    return out


def test_escaping_is_reversible(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choices(PIECES, k=draw.randint(0, 12))) for _ in range(1000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert df.filter(unescape(escape(F.col("text"))) != F.col("text")).isEmpty()


def test_round_trip_of_any_text(spark):
    draw = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "a: b\n%3A", "=x", "</turn>"]
    rows = [
        (c, t, draw.choice(roles), "".join(draw.choices(PIECES, k=draw.randint(0, 9))))
        for c in range(150)
        for t in range(draw.randint(1, 6))
    ]
    rows += [(None, None, "user", None), (None, 1, "assistant", None), (900, 0, "assistant", "x" * 200_000)]
    rows += [(901, 0, "assistant", "same")] * 2 + [(902, 0, "user", "\\" * 5000 + "</turn>")]
    made = format_chats(chats(spark, rows))
    got = chat_digests(made).collect()
    assert all(r.round_trip for r in got)
    want = expected(rows)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
    sizes = {r.conv_id: len(r.formatted) for r in made.collect()}
    assert sizes == {r.conv_id: r.formatted_chars for r in got}


def test_only_conflicts_are_escaped(spark):
    rows = [(1, 0, "user", "plain \\ text"), (1, 1, "assistant", "a </turn> b")]
    row = format_chats(chats(spark, rows)).first()
    assert row.escaped_turns == 1
    assert row.formatted == (
        "### User: plain \\ text\n</turn>\n### Assistant: a \\</turn> b\n</turn>\n"
    )
    span = row.loss_spans[0]
    assert row.formatted[span.start : span.end] == "a \\</turn> b"


def test_empty_table(spark):
    assert chat_digests(format_chats(chats(spark, []))).count() == 0


def test_query_against_sql(spark, sf_dir):
    rows, problems = compare(op1_chat_format(spark, sf_dir), connect(sf_dir), ORACLES["op1_chat_format"])
    assert rows > 1 and not problems


def test_no_python_on_executors(spark, sf_dir):
    plan = op1_chat_format(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
