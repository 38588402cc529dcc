"""Graph search against all products."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pytest

from footfall.llm import search_queries
from footfall.llm.graph_search import nearest_rows
from footfall.llm.vamana import ALPHA, beam_search, build_graph, lifted, pruned

SCHEMA = "vec_id long, embedding array<double>, id string, vector int, shard int, score string"


def product(a, b) -> float:
    """From the first component to the last; sum() would round otherwise."""
    return reduce(add, [x * y for x, y in zip(a, b)])


def brute(vectors: dict, queries, k: int) -> dict:
    """The ``k`` nearest others of each query, as (id, score)."""
    out = {}
    for q in queries:
        score = {i: product(vectors[q], v) for i, v in vectors.items() if i != q}
        out[q] = sorted(score.items(), key=lambda s: (-s[1], s[0]))[:k]
    return out


def rows_by_query(rows) -> dict:
    found: dict = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r[2], r.score))
        assert r.rank == len(found[r.query_id])
    return found


def recall(found: dict, want: dict) -> float:
    hits = [len({i for i, _ in found.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items() if w]
    return float(np.mean(hits))


def test_pruning():
    points = lifted(np.array([[0, 0], [1, 0], [1.1, 0.1], [0, 2], [-3, 0], [5, 5]]))
    assert np.allclose((points**2).sum(axis=1), 1)
    kept = pruned(points, np.array([0]), np.array([[1, 2, 3, 4, 5, 0, 1, -1]], np.int32), 4)[0]
    kept = kept[kept >= 0].tolist()
    apart = lambda i, j: float(((points[i] - points[j]) ** 2).sum())
    left = sorted({1, 2, 3, 4, 5}, key=lambda i: apart(0, i))
    want = []
    while left:
        want.append(left.pop(0))
        left = [i for i in left if ALPHA**2 * apart(want[-1], i) > apart(0, i)]
    assert kept == want[:4]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100])
def test_small_graphs_reach_every_node(n):
    vectors = np.random.default_rng(n).normal(size=(n, 3))
    order, edges = build_graph(vectors)
    assert sorted(order.tolist()) == list(range(n)) and edges.max(initial=-1) < n
    if n:
        nodes, _ = beam_search(lifted(vectors)[order], edges, lifted(vectors)[:3], 128)
        assert all(sorted(x for x in row if x >= 0) == list(range(n)) for row in nodes.tolist())


def test_recall_of_a_graph_with_a_dense_group():
    draw = np.random.default_rng(7)
    vectors = draw.normal(size=(3000, 32))
    vectors[::3] = vectors[0] + 0.02 * draw.normal(size=(1000, 32))
    vectors[5] *= 30
    order, edges = build_graph(vectors)
    queries = vectors[:200]
    nodes, _ = beam_search(vectors[order].astype(np.float32), edges, queries.astype(np.float32), 128)
    want = np.argsort(-(queries @ vectors[order].T), axis=1)[:, :20]
    assert np.mean([len({*a} & {*b}) / 20 for a, b in zip(want.tolist(), nodes.tolist())]) > 0.9


def test_odd_rows(spark):
    draw = np.random.default_rng(1)
    vectors = {i: draw.integers(-5, 6, 6).astype(float).tolist() for i in range(200)}
    vectors |= {1000 + i: vectors[3] for i in range(120)} | {-20: [7.0, 7.0, 7.0], 2020: [90.0, 0.0, 0.0, 0.0, 0.0, 0.0]}
    vectors = {i: v for i, v in vectors.items() if any(v)}
    odd = [(5020, None), (5040, []), (5060, [0.0, -0.0]), (5080, [1.0, None]), (5100, [float("nan"), 1.0])]
    odd += [(5120, [float("inf"), 1.0]), (None, [1.0, 2.0]), (40, vectors[40]), (40, vectors[40])]
    rows = [(i, v, "x", None, None, None) for i, v in [*vectors.items(), *odd]]
    table = spark.createDataFrame(rows, SCHEMA)
    queries = table.filter("vec_id % 20 = 0")
    want = brute(vectors, [i for i in vectors if i % 20 == 0], 20)
    for sizes in ({}, {"shard_rows": 60, "query_rows": 3}):
        found = rows_by_query(nearest_rows(table, queries, 20, **sizes).collect())
        # each shard has fewer nodes than a search keeps, so nothing is missed
        assert found == want
    few = nearest_rows(table.filter("vec_id IN (1, 2, 3)"), queries.filter("vec_id = 20"), 20).collect()
    assert len(few) == 3 and [r.rank for r in few] == [1, 2, 3]
    assert nearest_rows(table.limit(0), queries, 20).count() == 0
    assert nearest_rows(table, queries.limit(0), 20).count() == 0


def test_query(spark, sf_dir):
    for folder in (sf_dir, "/root/testdata/sf0.1"):
        given = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
        vectors = {r.vec_id: [float(x) for x in r.embedding] for r in given}
        want = brute(vectors, [i for i in vectors if i % 20 == 0], 20)
        found = rows_by_query(search_queries.op11_graph_search(spark, folder).collect())
        assert set(found) == set(want) and all(len(found[q]) == len(want[q]) for q in want)
        assert recall(found, want) >= 0.97
        for q, rows in found.items():
            assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))
            assert all(s == product(vectors[q], vectors[i]) for i, s in rows)
