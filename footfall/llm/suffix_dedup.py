"""Exact removal of repeated 100-byte strings by blockwise sorting of sampled suffixes.

Every byte that a string of ``LENGTH`` bytes covers is removed if the string also starts
earlier in the corpus (in a document of smaller id, or before in the same one).

Sorting all suffixes would move ten times the corpus, so only a cover of them is sorted.
The cover is chosen by content: of every string, the first of its ``KEY``-byte pieces
with the smallest hash.  Equal strings have their sample at the same place, so a string
can only be repeated where its sample's key is.  Neighbouring strings mostly share their
sample; such a run of strings is one row.

1. Samples are dealt by key into buckets; one bucket at a time is sorted by key, rank
   (the hash of all bytes of the run), document and place.  Runs of equal rank are equal
   in all their strings: all but the first are repeats.  A key with several ranks leaves
   its first runs to be looked into; a key with one run is done.
2. The strings of the runs left are named by hash, dealt into buckets by name, and sorted
   again; all but the first of a name are repeats.

Each task first resolves what repeats among its own rows, so equal runs and strings reach
a bucket once per task however many there are.  Places of repeats go back to the bucket
of their document, where the covered bytes are taken out.

Defined results: a null text counts as empty; texts shorter than the length lose nothing;
rows of equal ``doc_id`` are one document, whose text they repeat; a null id comes first;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.rolling import Rolling, U, mixed
from footfall.llm.tables import stage

LENGTH, KEY = 100, 32
BATCH_BYTES = 4 << 20
#: Bits of a packed hash that hold a place in a batch.
PLACE_BITS = 26
NO_ID = -(1 << 63)

MARKS = np.dtype([("doc", "<i8"), ("start", "<i4"), ("end", "<i4")])
SAMPLES = np.dtype([("key", "<u8"), ("rank", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "<i4")])
NAMES = np.dtype([("name", "<u8"), ("doc", "<i8"), ("start", "<i4")])


def packed(rows: np.ndarray) -> bytes:
    """Column by column, compressed; ids and places as differences."""
    columns = []
    for field in rows.dtype.names:
        column = rows[field]
        if field in ("doc", "start"):
            column = np.diff(column, prepend=column.dtype.type(0))
        columns.append(column.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(columns))


def unpacked(blob: bytes, dtype: np.dtype) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(blob)
    rows = np.empty(len(data) // dtype.itemsize, dtype)
    at = 0
    for field in dtype.names:
        kind = dtype[field]
        column = np.frombuffer(data, kind, len(rows), at)
        rows[field] = np.cumsum(column, dtype=kind) if field in ("doc", "start") else column
        at += len(rows) * kind.itemsize
    return rows


def joined(blobs: pa.ChunkedArray, dtype: np.dtype) -> np.ndarray:
    parts = [unpacked(b, dtype) for b in blobs.to_pylist() if b]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def merged(marks: np.ndarray) -> np.ndarray:
    """Overlapping and touching marks of a document as one."""
    if not len(marks):
        return marks
    marks = marks[np.lexsort((marks["start"], marks["doc"]))]
    # ends so far, with documents far apart
    number = np.cumsum(np.diff(marks["doc"], prepend=marks["doc"][:1]) != 0)
    reach = np.maximum.accumulate(marks["end"].astype(np.int64) + (number << 32))
    start = marks["start"].astype(np.int64) + (number << 32)
    new = np.ones(len(marks), bool)
    new[1:] = start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    out = marks[at]
    out["end"] = (reach[np.append(at[1:], len(marks)) - 1] & 0xFFFFFFFF).astype(np.int32)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by the first one's place."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[: len(x) - (width - have)], x[width - have :])
    return x


def windows(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Places and pieces of a text that hold each of its strings once."""
    yield 0, text[:BATCH_BYTES]
    step = BATCH_BYTES - (LENGTH - 1)
    for at in range(step, len(text) - (LENGTH - 1), step):
        yield at, text[at : at + BATCH_BYTES]


def samples(texts: list[bytes], ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The runs of strings that share a sample; ``places`` are the texts' in their documents."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        return np.empty(0, SAMPLES)
    if len(data) > 1 << PLACE_BITS:
        raise ValueError(f"{len(data)} bytes at once, more than {PLACE_BITS} bits can place")
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    rolling = Rolling(data)
    keys = rolling.of_length(KEY)
    place = np.arange(len(keys), dtype=np.uint64)
    order = (keys >> U(PLACE_BITS) << U(PLACE_BITS)) | place
    best = sliding_min(order, LENGTH - KEY + 1)
    # strings that do not end in the document they start in are no strings
    n_strings = np.maximum(sizes - LENGTH + 1, 0)
    inside = np.zeros(len(data) + 1, np.int8)
    has = n_strings > 0
    np.add.at(inside, (ends - sizes)[has], 1)
    np.add.at(inside, (ends - sizes + n_strings)[has], -1)
    valid = np.cumsum(inside[: len(best)], dtype=np.int8) > 0
    first = np.ones(len(best), bool)
    first[1:] = (best[1:] != best[:-1]) | ~valid[:-1]
    last = np.ones(len(best), bool)
    last[:-1] = first[1:] | ~valid[1:]
    start, stop = np.flatnonzero(first & valid), np.flatnonzero(last & valid)
    at = (best[start] & U((1 << PLACE_BITS) - 1)).astype(np.int64)
    rows = np.empty(len(start), SAMPLES)
    rows["key"] = keys[at]
    shape = ((at - start) * 1024 + stop - start).astype(np.uint64)
    rows["rank"] = mixed(rolling.of(start, stop + LENGTH) + shape)
    owner = np.searchsorted(ends, start, side="right")
    rows["doc"] = ids[owner]
    rows["start"] = start - (ends - sizes)[owner] + places[owner]
    rows["n"] = stop - start + 1
    return rows


def repeats(rows: np.ndarray, name: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted rows, and which of them have an earlier one of the same name.

    Rows of one document and place are one occurrence, not repeats of each other.
    """
    rows = rows[np.lexsort((rows["start"], rows["doc"], *(rows[f] for f in reversed(name))))]
    if not len(rows):
        return rows, np.zeros(0, bool)
    new = np.ones(len(rows), bool)
    new[1:] = np.any([rows[f][1:] != rows[f][:-1] for f in name], axis=0)
    leader = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = (rows["doc"] == rows["doc"][leader]) & (rows["start"] == rows["start"][leader])
    return rows, ~same


def marks_of(rows: np.ndarray, n: np.ndarray | int = 1) -> np.ndarray:
    marks = np.empty(len(rows), MARKS)
    marks["doc"], marks["start"] = rows["doc"], rows["start"]
    marks["end"] = rows["start"] + n + (LENGTH - 1)
    return merged(marks)


def bucket_of(numbers: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(numbers.view(np.uint64)) % U(buckets)).astype(np.int64)


def dealt(rows: np.ndarray, by: str, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each bucket, by document and place."""
    if not len(rows):
        return
    bucket = bucket_of(rows[by], buckets)
    order = np.lexsort((rows["start"], rows["doc"], bucket))
    rows, bucket = rows[order], bucket[order]
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    for start, end in zip(at, np.append(at[1:], len(rows)), strict=True):
        yield int(bucket[start]), rows[start:end]


def _batches(buckets: list[int], blobs: list[bytes | None], marks: list[bytes | None], other: str):
    return pa.table(
        {
            "bucket": pa.array(buckets, pa.int64()),
            other: pa.array(blobs, pa.binary()),
            "marks": pa.array(marks, pa.binary()),
        }
    )


def _table(groups, marks: np.ndarray, buckets: int, other: str) -> pa.Table:
    """Rows dealt into buckets, and marks by document, which only pass through."""
    number, blobs, passed = [], [], []
    for bucket, rows in groups:
        number.append(bucket)
        blobs.append(packed(rows))
        passed.append(None)
    for bucket, rows in dealt(marks, "doc", buckets):
        number.append(bucket)
        blobs.append(None)
        passed.append(packed(rows))
    return _batches(number, blobs, passed, other)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def sample_documents(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows, again = repeats(np.concatenate(held), ("key", "rank"))
            held.clear()
            marks = marks_of(rows[again], rows["n"][again])
            found = _table(dealt(rows[~again], "key", buckets), marks, buckets, "samples")
            yield from found.to_batches()

        for batch in batches:
            ids = _ids(batch.column(0))
            texts, owner, places, size = [], [], [], 0
            for at, text in enumerate(batch.column(1)):
                # a long text in windows, so that what is sampled at once stays small
                for place, piece in windows((text.as_py() or "").encode()):
                    texts.append(piece)
                    owner.append(at)
                    places.append(place)
                    size += len(piece)
                    if size >= BATCH_BYTES:
                        held.append(samples(texts, ids[owner], np.array(places)))
                        texts, owner, places, size = [], [], [], 0
            if texts:
                held.append(samples(texts, ids[owner], np.array(places)))
            if sum(map(len, held)) > 1_000_000:
                yield from flush()
        if held:
            yield from flush()

    return docs.mapInArrow(run, "bucket long, samples binary, marks binary")


def _look_up(table: pa.Table, buckets: int) -> pa.Table:
    """One bucket of samples: marks of repeated runs, and runs to look into."""
    rows, again = repeats(joined(table.column("samples"), SAMPLES), ("key", "rank"))
    marks = merged(
        np.concatenate(
            [marks_of(rows[again], rows["n"][again]), joined(table.column("marks"), MARKS)]
        )
    )
    firsts = rows[~again]
    if len(firsts):
        # rows of one document and place are there once more; the first is enough
        one = np.ones(len(firsts), bool)
        one[1:] = np.any([firsts[f][1:] != firsts[f][:-1] for f in ("key", "rank")], axis=0)
        firsts = firsts[one]
        alone = np.diff(firsts["key"], prepend=~firsts["key"][:1]) != 0
        alone &= np.append(alone[1:], True)
        firsts = firsts[~alone]
    runs = np.empty(len(firsts), MARKS)
    runs["doc"], runs["start"], runs["end"] = firsts["doc"], firsts["start"], firsts["start"] + firsts["n"]
    return _table(dealt(merged(runs), "doc", buckets), marks, buckets, "runs")


def _batched(docs: pa.Table) -> Iterator[tuple[pa.Table, list[bytes], np.ndarray, np.ndarray]]:
    """A bucket's documents by id, some megabytes at a time: rows, texts, ids, starts.

    ``starts`` are those of the texts in their joined bytes, and the end.
    """
    ids = _ids(docs.column("doc_id").combine_chunks())
    order = np.argsort(ids, kind="stable")
    docs, ids = docs.take(pa.array(order)), ids[order]
    press, column = zstandard.ZstdDecompressor(), docs.column("text")
    texts, size, first = [], 0, 0
    for at in range(1, docs.num_rows + 1):
        texts.append(press.decompress(column[at - 1].as_py()))
        size += len(texts[-1])
        # rows of one id stay together
        whole = at == docs.num_rows or ids[at] != ids[at - 1]
        if at == docs.num_rows or (size >= BATCH_BYTES and whole):
            starts = np.cumsum([0] + [len(t) for t in texts])
            yield docs.slice(first, at - first), texts, ids[first:at], starts
            texts, size, first = [], 0, at


def _own(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The rows, sorted by document, of the documents ``ids``."""
    return rows[
        np.searchsorted(rows["doc"], ids[0]) : np.searchsorted(rows["doc"], ids[-1], side="right")
    ]


def _names(runs: np.ndarray, texts: list[bytes], ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    place = starts[np.searchsorted(ids, runs["doc"])] + runs["start"]
    n = (runs["end"] - runs["start"]).astype(np.int64)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(place, n) + step
    rows = np.empty(len(at), NAMES)
    rows["name"] = Rolling(np.frombuffer(b"".join(texts), np.uint8)).of(at, at + LENGTH)
    rows["doc"] = np.repeat(runs["doc"], n)
    rows["start"] = np.repeat(runs["start"], n) + step
    return rows


def _name_strings(docs: pa.Table, found: pa.Table, buckets: int) -> pa.Table:
    """Names of the strings in the runs left in a bucket of documents."""
    if not found.num_rows:
        return _batches([], [], [], "names")
    runs = merged(joined(found.column("runs"), MARKS))
    docs = docs.filter(pa.array(np.isin(_ids(docs.column("doc_id").combine_chunks()), runs["doc"])))
    named = [_names(_own(runs, ids), texts, ids, starts) for _, texts, ids, starts in _batched(docs)]
    rows, again = repeats(np.concatenate(named), ("name",))
    return _table(dealt(rows[~again], "name", buckets), marks_of(rows[again]), buckets, "names")


def _compare_names(table: pa.Table, buckets: int) -> pa.Table:
    rows, again = repeats(joined(table.column("names"), NAMES), ("name",))
    marks = [marks_of(rows[again]), joined(table.column("marks"), MARKS)]
    return _table((), merged(np.concatenate(marks)), buckets, "names")


def _cut(docs: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of a bucket without the marked bytes."""
    marks = merged(joined(found.column("marks"), MARKS)) if found.num_rows else np.empty(0, MARKS)
    parts = [
        _cut_batch(rows, texts, ids, starts, _own(marks, ids))
        for rows, texts, ids, starts in _batched(docs)
    ]
    return pa.concat_tables(parts) if parts else _kept(docs.slice(0, 0), [], [], [], [])


def _kept(rows: pa.Table, n_bytes, n_removed, n_spans, kept) -> pa.Table:
    return pa.table(
        {
            "doc_id": rows.column("doc_id"),
            "n_bytes": pa.array(n_bytes, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()),
            "kept": pa.array(kept, pa.binary()),
        }
    )


def _cut_batch(
    rows: pa.Table, texts: list[bytes], ids: np.ndarray, starts: np.ndarray, marks: np.ndarray
) -> pa.Table:
    data = np.frombuffer(b"".join(texts), np.uint8)
    # a mark holds for every row of its document
    begin = np.searchsorted(ids, marks["doc"], side="left")
    copies = np.searchsorted(ids, marks["doc"], side="right") - begin
    row = np.repeat(begin, copies) + np.arange(copies.sum()) - np.repeat(
        np.cumsum(copies) - copies, copies
    )
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, starts[row] + np.repeat(marks["start"], copies), 1)
    np.add.at(edge, starts[row] + np.repeat(marks["end"], copies), -1)
    gone = np.cumsum(edge[:-1]) > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    heads = starts[:-1][starts[:-1] < starts[1:]]
    begins[heads] = gone[heads]
    sums = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (gone, begins)]
    n_removed, n_spans = (s[starts[1:]] - s[starts[:-1]] for s in sums)
    kept = [
        data[s:e][~gone[s:e]].tobytes() if n else text
        for text, s, e, n in zip(texts, starts[:-1], starts[1:], n_removed, strict=True)
    ]
    return _kept(rows, np.diff(starts), n_removed, n_spans, kept)


def _squeezed(docs: DataFrame, buckets: int) -> DataFrame:
    """The documents with their bucket, texts compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [press.compress((t.as_py() or "").encode()) for t in batch.column(1)]
            columns = [pa.array(bucket_of(_ids(batch.column(0)), buckets)), batch.column(0)]
            columns.append(pa.array(texts, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"bucket long, doc_id {kind}, text binary")


def remove_repeats(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (bytes).

    ``buckets`` bounds what one task holds: about the corpus over their number.  Each
    bucket sends at most one row to each other, so more of them mean more small rows.
    """
    docs = docs.select("doc_id", "text")
    if buckets is None:
        buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = sample_documents(docs, buckets).groupBy("bucket").applyInArrow(
        lambda t: _look_up(t, buckets), "bucket long, runs binary, marks binary"
    )
    found = stage(found, "repeat_runs")
    texts = _squeezed(docs, buckets).groupBy("bucket")
    runs = found.filter("runs IS NOT NULL").select("bucket", "runs").groupBy("bucket")
    names = texts.cogroup(runs).applyInArrow(
        lambda a, b: _name_strings(a, b, buckets), "bucket long, names binary, marks binary"
    )
    more = names.groupBy("bucket").applyInArrow(
        lambda t: _compare_names(t, buckets), "bucket long, names binary, marks binary"
    )
    marks = found.filter("marks IS NOT NULL").select("bucket", "marks").union(
        more.select("bucket", "marks")
    )
    return texts.cogroup(marks.groupBy("bucket")).applyInArrow(
        _cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    )
