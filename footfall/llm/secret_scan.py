"""Secret scans with corpus-wide ownership frequency.

Every text is scanned for assigned values, access key ids and long hexadecimal runs
(the base kinds), and for other long tokens that mix letters and digits.  The hashes
of all values found are aggregated over the corpus by distinct repositories and
owners.  A value is taken as a live credential if few owners hold it (``MAX_OWNERS``),
each in few of its repositories (``MAX_REPOS`` on average); one that many owners hold, or
that one owner repeats all over, is a widely copied example.  Base spans are always
reported; another token is reported (kind ``token``) where its value looks live and has
enough entropy.  Every span comes with both counts.

An owner is a ``source``; a document stands for a repository where the table has none.

Defined results: null and empty texts have no spans; a null owner counts as one owner;
repeated rows are reported each and count as one repository; other columns are kept
out of the result; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.llm.tables import as_row, free_name, from_row, stage

#: Kinds of spans, in the order in which they are listed.
KINDS = ("assign", "access", "hex", "token")
BASE = KINDS[:3]
#: Owners up to which a value counts as owner-specific.
MAX_OWNERS = 2
#: Repositories of each owner up to which it counts as the owner's own, on average.
MAX_REPOS = 10
#: Bits a character of other tokens must have at least.
MIN_ENTROPY = 3.0
SPAN = "struct<kind:string,start:int,end:int,digest:long,entropy:double>"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    "(" + "|".join(map(_either_case, KEYWORDS)) + ")"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
LETTER, DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")


def entropy(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values())


def find_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind; places in code points."""
    found = []
    lower = text.lower()
    if any(hint in lower for hint in HINTS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                found.append(("assign", m.start(), m.end(), m[2]))
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if any(len(word) >= 20 for word in text.split()):
        found += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
        taken = sorted((start, end) for _, start, end, _ in found)
        for m in TOKEN.finditer(text):
            mixed = DIGIT.search(m[0]) and LETTER.search(m[0])
            if mixed and not any(s < m.end() and m.start() < e for s, e in taken):
                found.append(("token", *m.span(), m[0]))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(
        pa.struct(
            [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
            + [("digest", pa.int64()), ("entropy", pa.float64())]
        )
    )
    for batch in batches:
        rows = []
        for text in batch.column(batch.num_columns - 1):
            rows.append(
                [
                    {
                        "kind": k,
                        "start": a,
                        "end": b,
                        "digest": int.from_bytes(
                            hashlib.blake2b(v.encode(), digest_size=8).digest(), "big", signed=True
                        ),
                        "entropy": entropy(v),
                    }
                    for k, a, b, v in find_spans(text.as_py() or "")
                ]
            )
        columns = [*batch.columns[:-1], pa.array(rows, kind)]
        names = [*batch.schema.names[:-1], "spans"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    owner_col: str = "source",
    row: Column | None = None,
) -> DataFrame:
    """Candidates of every row, written once: row, id, owner, spans."""
    rows = docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
        F.col(id_col).alias("id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        "text",
    )
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row long, id {kind}, owner string, spans array<{SPAN}>"
    return stage(rows.mapInArrow(_scan, schema), "secret_candidates")


def ownership(candidates: DataFrame) -> DataFrame:
    """Of each value: its distinct repositories and owners."""
    values = candidates.select("id", "owner", F.explode("spans.digest").alias("digest"))
    each = values.groupBy("digest", "owner", "id").agg(F.lit(1).alias("one"))
    held = each.groupBy("digest", "owner").agg(F.count("*").alias("n_repos"))
    return held.groupBy("digest").agg(
        F.count("*").alias("n_owners"), F.sum("n_repos").alias("n_repos")
    )


def judged(
    candidates: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS
) -> DataFrame:
    """Of each row with candidates: its spans, each with ``live`` and ``reported``."""
    values = stage(ownership(candidates), "secret_ownership")
    each = candidates.select("row", F.posexplode("spans").alias("place", "span"))
    each = each.select("row", "place", "span", F.col("span.digest").alias("digest"))
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos * F.col("n_owners"))
    strong = F.col("span.entropy") >= MIN_ENTROPY
    span = F.struct(
        "place",
        F.col("span.kind").alias("kind"),
        F.col("span.start").alias("start"),
        F.col("span.end").alias("end"),
        "n_owners",
        "n_repos",
        live.alias("live"),
        (F.col("span.kind").isin(*BASE) | (live & strong)).alias("reported"),
    )
    known = each.join(values, "digest").select("row", span.alias("span"))
    return known.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    owner_col: str = "source",
    max_owners: int = MAX_OWNERS,
    max_repos: int = MAX_REPOS,
) -> DataFrame:
    """One row per input row: the id and the reported spans, by start."""
    candidates = scan(docs, id_col, owner_col)
    verdicts = judged(candidates, max_owners, max_repos)
    reported = F.filter(F.col("spans"), lambda s: s["reported"])
    none = F.array().cast(
        "array<struct<place:int,kind:string,start:int,end:int,n_owners:long,n_repos:long,"
        "live:boolean,reported:boolean>>"
    )
    return candidates.select("row", F.col("id").alias(id_col)).join(verdicts, "row", "left").select(
        id_col, F.coalesce(reported, none).alias("spans")
    )


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    texts = F.transform(
        spans,
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(texts, ",")


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the spans (last column) in the texts (the column before it)."""
    for batch in batches:
        texts = []
        for text, spans in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            if spans:
                parts, at = [], 0
                for span in spans:
                    if span["end"] > at:
                        parts += [text[at : max(at, span["start"])], f"[{span['kind']}]"]
                        at = span["end"]
                text = "".join([*parts, text[at:]])
            texts.append(text)
        columns = [batch.column(0), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "text"])


def redact_secrets(
    docs: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS
) -> DataFrame:
    """The documents with every reported span replaced by its kind in brackets."""
    row = free_name(docs, "_row")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "secret_documents")
    verdicts = judged(scan(numbered, row=F.col(row)), max_owners, max_repos)
    reported = F.filter(F.col("spans"), lambda s: s["reported"])
    spans = F.transform(reported, lambda s: F.struct(s["kind"], s["start"], s["end"]))
    at = free_name(numbered, "_spans")
    found = verdicts.select(F.col("row").alias(row), spans.alias(at))
    others = docs.drop("text")
    both = numbered.join(found, row, "left").select(as_row(others), "text", at)
    schema = T.StructType([T.StructField("row", others.schema), T.StructField("text", T.StringType())])
    clean = both.mapInArrow(_redact, schema)
    own = dict(zip(others.columns, from_row(clean, others.columns), strict=True))
    if "n_chars" in own:
        own["n_chars"] = F.length("text").cast("long").alias("n_chars")
    return clean.select(*(own.get(c, F.col("text")) for c in docs.columns))
