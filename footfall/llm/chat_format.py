"""Chat formatting with a grammar round trip.

A conversation becomes one text.  Its grammar::

    text := turn*
    turn := "### " label ": " body "\n</turn>\n"

Control strings are ``</turn>`` and the headers of the known roles.  Inside a body
a control string always has at least one backslash before it; a parser takes one
off.  Every turn is first rendered as it is and parsed again.  Where that does not
give the source back, its body is escaped (one more backslash before each control
string), after which it always does: real control strings follow a newline or stand
at the start, so they never have a backslash before them.

Defined results: a null text counts as empty, a null role as an empty one; roles
other than the known ones are kept, percent-encoded; rows of a null ``conv_id`` form
one conversation; equal turn numbers are ordered by role and text; repeated rows are
turns of their own; an empty table gives an empty result; other columns are ignored.

Only built-in functions: one shuffle by conversation, no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant", "tool")
END = "</turn>"
CONTROL = r"(?:### (?:System|User|Assistant|Tool): |</turn>)"
#: Characters of unknown roles that the header cannot hold, "%" first.
ENCODED = (("%", "%25"), (":", "%3A"), ("\n", "%0A"), ("<", "%3C"), ("#", "%23"), ("\\", "%5C"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)(\\*+{CONTROL})", r"\\$1")


def unescape(body: Column) -> Column:
    return F.regexp_replace(body, rf"(?<!\\)\\(\\*+{CONTROL})", "$1")


def _label(role: Column) -> Column:
    other = role
    for char, code in ENCODED:
        other = F.replace(other, F.lit(char), F.lit(code))
    return F.when(role.isin(*ROLES), F.initcap(role)).otherwise(F.concat(F.lit("="), other))


def _role(label: Column) -> Column:
    other = F.substring(label, 2, 1 << 30)
    for char, code in reversed(ENCODED):
        other = F.replace(other, F.lit(code), F.lit(char))
    return F.when(label.startswith("="), other).otherwise(F.lower(label))


def header(role: Column) -> Column:
    return F.concat(F.lit("### "), _label(role), F.lit(": "))


def render(role: Column, body: Column) -> Column:
    return F.concat(header(role), body, F.lit(f"\n{END}\n"))


def _parse_turn(piece: Column) -> Column:
    head = F.regexp_extract(piece, r"^\n?### [^:\n]*: ", 0)
    body = piece.substr(F.length(head) + 1, F.length(piece) - F.length(head) - 1)
    good = (head != "") & piece.endswith("\n") & ~body.rlike(rf"(?<!\\){CONTROL}")
    label = F.regexp_extract(head, r"### ([^:\n]*): ", 1)
    return F.when(good, F.struct(_role(label).alias("role"), unescape(body).alias("text")))


def parse(formatted: Column) -> Column:
    """The turns of a text, in order; null for what the grammar does not allow."""
    pieces = F.split(formatted, rf"(?<!\\){END}", -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), _parse_turn)


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, escaped_turns, round_trip.

    ``loss_spans`` are the places of assistant bodies in ``formatted``, in code points,
    end exclusive.
    """
    source = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    as_is = parse(render(F.col("role"), F.col("text")))
    identical = as_is.eqNullSafe(F.array(F.struct("role", "text")))
    turns = source.withColumn("escaped", ~identical).withColumn(
        "body", F.when(F.col("escaped"), escape(F.col("text"))).otherwise(F.col("text"))
    )
    turns = turns.withColumn("rendered", render(F.col("role"), F.col("body")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("rendered").cast("long")).over(before), F.lit(0)) + F.length(
        header(F.col("role"))
    )
    placed = turns.select(
        "*", F.row_number().over(order).alias("place"), start.cast("long").alias("start")
    )
    item = F.struct(
        "place", "role", "text", "rendered", "escaped", "start",
        (F.col("start") + F.length("body")).alias("end"),
    )
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    items = F.col("items")
    formatted = whole.select(
        "conv_id",
        "items",
        F.array_join(F.transform(items, lambda x: x["rendered"]), "").alias("formatted"),
    )
    assistants = F.filter(items, lambda x: x["role"] == "assistant")
    return formatted.select(
        "conv_id",
        "formatted",
        F.transform(assistants, lambda x: F.struct(x["start"], x["end"])).alias("loss_spans"),
        F.size(F.filter(items, lambda x: x["escaped"])).alias("escaped_turns"),
        parse(F.col("formatted"))
        .eqNullSafe(F.transform(items, lambda x: F.struct(x["role"], x["text"])))
        .alias("round_trip"),
    )


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the formatted texts, as counts and digests."""
    spans = F.transform(
        "loss_spans",
        lambda s: unescape(
            F.col("formatted").substr(s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))
        ),
    )
    back = formatted.select(
        "*", parse(F.col("formatted")).alias("turns"), F.array_join(spans, "").alias("loss")
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
