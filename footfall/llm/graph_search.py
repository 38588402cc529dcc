"""Nearest neighbours by inner product from robust-pruned graphs, one for each shard.

Rows are dealt to shards of about ``SHARD_ROWS`` by a hash of their id, so every shard is a
sample of all rows whatever their order.  Within a shard equal vectors are one node with a
list of ids: large groups of copies cost one node and ties between them are settled by the
ids.  The index is a table with one row per node: shard, node, ids, vector and neighbours.
Queries meet it in blocks, each pair of a shard and a block in a group of its own; every
shard is searched for every query.

Scores are products in double precision, added up from the first component to the last.
Rows that share an id count as one: the one with the smallest vector.  Rows without an id,
or whose vector is null, zero or holds a null or a number that is not finite, take no part.
Shorter vectors count as filled up with zeros.  Empty tables give no rows.  Graphs and
searches work in single precision: where some vectors of a shard are many thousand times
as long as others, the short ones cannot be told apart well and are found less often.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.tables import stage
from footfall.llm.vamana import BATCH, beam_search, build_graph
from footfall.llm.vectors import block_of, blocks, finite, in_each_block, matrix, padded

#: Rows of a shard, about; queries that meet a shard at once, about.
SHARD_ROWS, QUERY_ROWS = 8192, 16384
#: Nodes a search keeps.
BEAM = 128

INDEX = "shard int, node int, ids array<long>, vector array<double>, neighbours array<int>"


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (doubles) of the rows that take part, one for each id."""
    vector = F.col(vector_col)
    some = finite(vector) & F.exists(vector, lambda x: x != 0) & F.col(id_col).isNotNull()
    found = rows.filter(some).select(
        F.col(id_col).cast("long").alias("id"), vector.cast("array<double>").alias("vector")
    )
    return found.groupBy("id").agg(F.min("vector").alias("vector"))


def _lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum(sizes)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def _nodes(shard: int, ids: np.ndarray, vectors: np.ndarray) -> pa.Table:
    """A shard's rows of the index."""
    different, node = np.unique(vectors, axis=0, return_inverse=True)
    order, edges = build_graph(different)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    node = place[node.ravel()]
    by_node = np.lexsort((ids, node))
    there = edges >= 0
    count, width = len(order), vectors.shape[1]
    columns = [
        pa.array(np.full(count, shard), pa.int32()),
        pa.array(np.arange(count), pa.int32()),
        _lists(ids[by_node], np.bincount(node, minlength=count), pa.int64()),
        _lists(different[order].ravel(), np.full(count, width), pa.float64()),
        _lists(edges[there], there.sum(axis=1), pa.int32()),
    ]
    return pa.table(columns, ["shard", "node", "ids", "vector", "neighbours"])


def build_index(rows: DataFrame, width: int, shards: int) -> DataFrame:
    """The index of ``rows`` (id, vector); write it, or stage it, before it is searched."""

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        vectors = matrix(table["vector"], width, np.float64) + 0.0
        return _nodes(key[0].as_py(), table["id"].to_numpy(), vectors)

    dealt = rows.select(
        block_of(F.col("id"), shards).alias("shard"), "id", padded(F.col("vector"), width).alias("vector")
    )
    return dealt.groupBy("shard").applyInArrow(build, INDEX)


class _Shard:
    def __init__(self, table: pa.Table, width: int):
        table = table.sort_by("node")
        self.vectors = matrix(table["vector"], width, np.float64)
        # searches work in single precision on vectors of a length that it can hold
        self.points = (self.vectors / np.abs(self.vectors).max()).astype(np.float32)
        neighbours = table["neighbours"].combine_chunks()
        sizes = np.diff(neighbours.offsets.to_numpy())
        self.edges = np.full((len(table), max(int(sizes.max(initial=0)), 1)), -1, np.int32)
        self.edges[np.arange(self.edges.shape[1]) < sizes[:, None]] = neighbours.flatten().to_numpy()
        ids = table["ids"].combine_chunks()
        self.begin, self.ids = ids.offsets.to_numpy().astype(np.int64), ids.flatten().to_numpy()
        self.begin -= self.begin[0]

    def nearest(
        self, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the queries, ids and scores of their ``k`` nearest other rows."""
        light = (queries / np.abs(queries).max(axis=1, keepdims=True)).astype(np.float32)
        nodes, _ = beam_search(self.points, self.edges, light, beam)
        row, place = np.nonzero(nodes >= 0)
        node = nodes[row, place]
        products = queries[row] * self.vectors[node]
        score = np.add.accumulate(products, axis=1)[:, -1]
        # of equal vectors the first ids are enough, with one to spare for the query's own
        size = np.minimum(self.begin[node + 1] - self.begin[node], k + 1)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        ids = self.ids[np.repeat(self.begin[node], size) + within]
        row, score = np.repeat(row, size), np.repeat(score, size)
        other = ids != query_ids[row]
        row, score, ids = row[other], score[other], ids[other]
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        best = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
        return row[best], ids[best], score[best]


def search_index(
    index: DataFrame,
    queries: DataFrame,
    width: int,
    shards: int,
    query_blocks: int,
    k: int,
    beam: int,
) -> DataFrame:
    """query_id, rank, id and score of the ``k`` nearest rows found for each of ``queries``."""

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        query_ids = right["id"].to_numpy()
        vectors = matrix(right["vector"], width, np.float64) + 0.0
        parts: list[tuple[np.ndarray, ...]] = []
        if len(left) and len(right):
            shard = _Shard(left, width)
            for at in range(0, len(right), BATCH):
                own = query_ids[at : at + BATCH]
                row, ids, score = shard.nearest(own, vectors[at : at + BATCH], k, beam)
                parts.append((own[row], ids, score))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0)] * 3
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "id", "score"])

    left = in_each_block(index, "qb", query_blocks).groupBy("shard", "qb")
    asked = queries.select(
        "id", padded(F.col("vector"), width).alias("vector"), block_of(F.col("id"), query_blocks, 1).alias("qb")
    )
    asked = in_each_block(asked, "shard", shards).groupBy("shard", "qb")
    found = left.cogroup(asked).applyInArrow(look, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "id", "score")


def nearest_rows(
    rows: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    beam: int = BEAM,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, id and score: the ``k`` nearest rows found for each query.

    A row with the query's own id is not among them.  Every row is indexed; which rows are
    found depends on the beam, ties go to the smaller id.
    """
    rows = stage(usable(rows, id_col, vector_col), "search_rows")
    queries = stage(usable(queries, id_col, vector_col), "search_queries")
    size = lambda df: df.agg(F.count("*"), F.max(F.size("vector"))).first()
    (total, wide), (asked, wider) = size(rows), size(queries)
    width, shards = max(wide or 1, wider or 1), blocks(total, shard_rows)
    index = stage(build_index(rows, width, shards), "search_index")
    return search_index(index, queries, width, shards, blocks(asked, query_rows), k, max(beam, k + 1))
