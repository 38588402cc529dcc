"""Hard negatives by Four-Russians scoring.

Vectors hold whole numbers.  An anchor's components are taken eight at a time; for each
group of eight a table holds the sums of all 256 subsets of its components.  Candidates
are kept as bit planes in two's complement: one byte has one bit of eight components.  The
byte looks its subset sum up, the groups' sums are added, and the planes are put together
by doubling and adding, highest plane (which counts negative) first.  This gives the full
inner product exactly, without a multiplication.

Anchors and candidates meet in blocks of bounded size, each pair of blocks in a group of
its own; a block's best rows are all that leaves it.  Blocks follow a hash of the row's
number, so equal vectors and frequent labels are spread evenly.

Rows that share an id count as one: the one with the smallest label, then vector.  Rows
without an id, label or vector, or with a component that is null or not finite, take no
part.  Shorter vectors count as filled up with zeros.  An empty table gives no rows.  A
table whose inner products might not fit a long is refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.llm.tables import stage
from footfall.llm.vectors import block_of, blocks, in_each_block, matrix, padded

GROUP = 8
#: Rows of a block of candidates and of a block of anchors.
CANDIDATES, ANCHORS = 2048, 1024
#: Candidates scored at a time, so that the sums stay in a core's cache.
CHUNK = 256
#: Negatives score from 50 to 95 hundredths of the positive.
LOW, HIGH = 50, 95


def bits_needed(largest: int) -> int:
    """Planes of two's complement for numbers from -largest to largest."""
    return largest.bit_length() + 1


def bit_planes(rows: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups): byte g of plane b has bit b of components 8g to 8g+7."""
    n, width = rows.shape
    groups = -(-width // GROUP)
    full = np.zeros((n, groups * GROUP), np.int64)
    full[:, :width] = rows
    out = np.empty((n, planes, groups), np.uint8)
    for b in range(planes):
        out[:, b] = np.packbits(((full >> b) & 1).astype(np.uint8), axis=1, bitorder="little")
    return out


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): the sum of each subset of each group of components."""
    n, width = anchors.shape
    groups = -(-width // GROUP)
    full = np.zeros((groups * GROUP, n), np.int64)
    full[:width] = anchors.T
    sums = np.zeros((groups, 1 << GROUP, n), np.int64)
    for i in range(GROUP):
        sums[:, 1 << i : 2 << i] = sums[:, : 1 << i] + full[i::GROUP, None, :]
    largest = int(np.abs(anchors).sum(axis=1).max(initial=0))
    kind = next(k for k in (np.int16, np.int32, np.int64) if largest <= np.iinfo(k).max)
    return sums.astype(kind)


def inner_products(sums: np.ndarray, planes: np.ndarray, kind: type) -> np.ndarray:
    """(candidates, anchors), exact, as numbers of ``kind``."""
    groups, _, n = sums.shape
    count, depth, _ = planes.shape
    out = np.zeros((count, n), kind)
    for at in range(0, count, CHUNK):
        part, total = planes[at : at + CHUNK], out[at : at + CHUNK]
        size = len(part)
        plane, looked_up = np.empty((size, n), sums.dtype), np.empty((size, n), sums.dtype)
        for b in range(depth - 1, -1, -1):
            plane[:] = 0
            for g in range(groups):
                np.take(sums[g], part[:, b, g], axis=0, out=looked_up, mode="clip")
                plane += looked_up
            total += total
            if b == depth - 1:
                total -= plane
            else:
                total += plane
    return out


def _best(rows: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ``limit`` highest of each column, upper rows first."""
    order = np.argsort(-rows.astype(np.int64), axis=0, kind="stable")[:limit]
    return order.ravel(), np.broadcast_to(np.arange(rows.shape[1]), order.shape).ravel()


class _Block:
    """The candidates and anchors of a pair of blocks."""

    def __init__(self, anchors: pa.Table, rows: pa.Table, width: int, depth: int, wide: bool):
        rows = rows.sort_by("id")
        self.ids, self.labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        self.anchor_ids, self.anchor_labels = anchors["id"].to_numpy(), anchors["label"].to_numpy()
        flat = np.frombuffer(b"".join(rows["planes"].to_pylist()), np.uint8)
        self.planes = flat.reshape(len(rows), depth, -(-width // GROUP))
        self.vectors = matrix(anchors["vector"], width, np.int64)
        self.kind = np.int64 if wide else np.int32

    def scores(self, rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        return inner_products(subset_sums(self.vectors[anchors]), self.planes[rows], self.kind)


def _positives(block: _Block, limit: int) -> Iterator[tuple[np.ndarray, ...]]:
    for label in np.unique(block.anchor_labels):
        rows = np.flatnonzero(block.labels == label)
        anchors = np.flatnonzero(block.anchor_labels == label)
        if not len(rows):
            continue
        scores = block.scores(rows, anchors)
        # one more than wanted, since an anchor is no positive of its own
        found, of = _best(scores, limit + 1)
        other = block.ids[rows[found]] != block.anchor_ids[anchors[of]]
        found, of = found[other], of[other]
        yield block.anchor_ids[anchors[of]], block.ids[rows[found]], scores[found, of].astype(np.int64)


def _negatives(
    block: _Block, positives: pa.ChunkedArray, limit: int
) -> Iterator[tuple[np.ndarray, ...]]:
    lists = positives.to_pylist()
    most = max(map(len, lists), default=0)
    if not most or not len(block.ids):
        return
    ids, scores = np.zeros((2, len(lists), most), np.int64)
    there = np.zeros((len(lists), most), bool)
    for a, found in enumerate(lists):
        for j, row in enumerate(found):
            ids[a, j], scores[a, j], there[a, j] = row["id"], row["score"], True
    low, high = -((-LOW * scores) // 100), (HIGH * scores) // 100
    low, high = np.where(there, low, np.iinfo(np.int64).max), np.where(there, high, np.iinfo(np.int64).min)
    got = block.scores(np.arange(len(block.ids)), np.arange(len(lists)))
    fits = (got >= low.min(axis=1)) & (got <= high.max(axis=1))
    fits &= block.labels[:, None] != block.anchor_labels
    row, anchor = np.nonzero(fits)
    score = got[row, anchor].astype(np.int64)
    order = np.lexsort((row, -score, anchor))
    row, anchor, score = row[order], anchor[order], score[order]
    for j in range(most):
        inside = (score >= low[anchor, j]) & (score <= high[anchor, j])
        r, a, s = row[inside], anchor[inside], score[inside]
        place = np.arange(len(a)) - np.searchsorted(a, a, "left")
        r, a, s = r[place < limit], a[place < limit], s[place < limit]
        yield block.anchor_ids[a], ids[a, j], scores[a, j], block.ids[r], s


def _table(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names)


def _packed(rows: DataFrame, width: int, depth: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = bit_planes(matrix(batch["vector"], width, np.int64), depth)
            packed = pa.array([p.tobytes() for p in planes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], packed], ["id", "label", "planes"])

    return rows.select("id", "label", "vector").mapInArrow(run, "id long, label long, planes binary")


def _top(rows: DataFrame, key: list[str], score: str, number: str, limit: int) -> DataFrame:
    best = Window.partitionBy(*key).orderBy(F.desc(score), number)
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    candidate_rows: int = CANDIDATES,
    anchor_rows: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``rows`` has id, label and vector (whole numbers); ``anchors`` is a condition on them.
    An anchor's positives are the other rows of its label with the highest scores; the
    negatives of a positive are rows of other labels with the highest scores from 50 to 95
    hundredths of the positive's.  Ties go to the smaller id.
    """
    whole = rows.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    whole = whole.select(
        F.col("id").cast("long"),
        F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
        F.struct(F.col("label").cast("long").alias("label"), "vector").alias("row"),
    )
    whole = whole.groupBy("id").agg(F.max("is_anchor").alias("is_anchor"), F.min("row").alias("row"))
    whole = stage(whole.select("id", "is_anchor", "row.label", "row.vector"), "negative_rows")
    # -1 - x instead of -x, which the least long has not
    size = lambda x: F.when(x < 0, F.bitwise_not(x)).otherwise(x)
    largest = F.max(F.array_max(F.transform("vector", size)))
    seen = whole.agg(F.count("*"), F.count_if("is_anchor"), F.max(F.size("vector")), largest).first()
    total, n_anchors, width, largest = (int(x or 0) for x in seen)
    width, largest = max(width, 1), largest + 1
    if largest * largest > (1 << 63) // (100 * width):
        raise ValueError(f"inner products of {width} numbers up to {largest} may not fit a long")
    depth, wide = bits_needed(largest), width * largest * largest >= 1 << 31
    whole = whole.withColumn("vector", padded(F.col("vector"), width))
    many, few = blocks(total, candidate_rows), blocks(n_anchors, anchor_rows)
    packed = stage(_packed(whole, width, depth), "negative_planes")
    packed = in_each_block(packed, "ab", few).withColumn("cb", block_of(F.col("id"), many))
    chosen = whole.filter("is_anchor").select("id", "label", "vector")
    chosen = chosen.withColumn("ab", block_of(F.col("id"), few, seed=1))

    def meet(left: DataFrame, found, schema: str) -> DataFrame:
        left = in_each_block(left, "cb", many).groupBy("ab", "cb")
        return left.cogroup(packed.groupBy("ab", "cb")).applyInArrow(found, schema)

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left, right, width, depth, wide)
        return _table(list(_positives(block, positives)), ["anchor_id", "id", "score"])

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left, right, width, depth, wide)
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return _table(list(_negatives(block, left["positives"], negatives)), names)

    near = meet(chosen, first, "anchor_id long, id long, score long")
    near = _top(near, ["anchor_id"], "score", "id", positives)
    near = near.groupBy(F.col("anchor_id").alias("id")).agg(
        F.collect_list(F.struct(F.col("id"), "score")).alias("positives")
    )
    chosen = stage(chosen.join(near, "id"), "negative_anchors")
    far = meet(
        chosen,
        second,
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    return _top(far, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, taken as doubles."""
    number = lambda x: F.floor(F.lit(float(scale)) * x.cast(T.DoubleType()))
    return F.transform(vector, number)
