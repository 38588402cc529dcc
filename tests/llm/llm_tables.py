"""Small documents with all that may be odd about a table."""

from __future__ import annotations

LONG = "Lorem ipsum dolor sit amet, consectetur adipiscing elit. " * 3000


def documents(spark, extra: str = "verdict string, node long", more=()):
    """A table with nulls, empty and long texts, equal rows, and the columns ``extra``."""
    texts = [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "one"),
        (5, LONG),
        (6, "x" * 100_000),
        (7, "İstanbul ſ K \x1c ²  😀\r\n"),
        (8, "the same words in two rows of one id, again"),
        (8, "the same words in two rows of one id, again"),
        (9, "the same words in two rows of one id, again"),
        (None, "a text without an id that is long enough to be kept by any rule of words"),
        *more,
    ]
    names = [part.split(" ")[0] for part in extra.split(", ")]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    rows = [
        (i, t, None if i == 4 else "en", None if i == 5 else "s1", None, *[None] * len(names))
        for i, t in texts
    ]
    return spark.createDataFrame(rows, schema), texts
