"""Hard negatives against scores worked out pair by pair."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, connect
from footfall.llm.hard_negatives import bit_planes, bits_needed, hard_negatives, inner_products, subset_sums

SCHEMA = "id long, label long, vector array<long>, rank int, planes string, row string, ab int"


@pytest.mark.parametrize("width, largest", [(1, 1), (7, 3), (8, 255), (64, 160), (65, 70_000), (3, 1 << 28)])
def test_scores(width, largest):
    draw = np.random.default_rng(width)
    anchors = draw.integers(-largest, largest + 1, (9, width))
    rows = draw.integers(-largest, largest + 1, (700, width))
    rows[:3] = [[-largest] * width, [largest] * width, [0] * width]
    planes = bit_planes(rows, bits_needed(largest))
    kind = np.int64 if width * largest * largest >= 1 << 31 else np.int32
    assert (inner_products(subset_sums(anchors), planes, kind) == rows @ anchors.T).all()


def brute(rows, every: int, n_pos: int = 5, n_neg: int = 3) -> set:
    once = {}
    for i, label, vector in rows:
        if None not in (i, label, vector) and (i not in once or (label, vector) < once[i]):
            once[i] = (label, vector)
    score = lambda a, b: sum(x * y for x, y in zip(once[a][1], once[b][1]))
    out = set()
    for a in once:
        if a % every:
            continue
        ranked = sorted((b for b in once if b != a), key=lambda b: (-score(a, b), b))
        for p in [b for b in ranked if once[b][0] == once[a][0]][:n_pos]:
            fits = lambda s: 50 * score(a, p) <= 100 * s <= 95 * score(a, p)
            others = [b for b in ranked if once[b][0] != once[a][0] and fits(score(a, b))]
            out |= {(a, p, k, b, score(a, p), score(a, b)) for k, b in enumerate(others[:n_neg], 1)}
    return out


def found(spark, rows, every, **sizes) -> set:
    table = spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)
    got = hard_negatives(table, F.col("id") % every == 0, **sizes).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


@pytest.mark.parametrize("seed, sizes", [(1, {}), (2, {"candidate_rows": 40, "anchor_rows": 7})])
def test_against_all_pairs(spark, seed, sizes):
    draw = random.Random(seed)
    vector = lambda: [draw.randint(-9, 9) for _ in range(draw.choice([11, 11, 11, 4]))]
    rows = [(i, draw.choice([0, 0, 0, 0, 1, 2, -3]), vector()) for i in range(220)]
    # ties, repeated rows, rows of one number that differ, and rows that take no part
    rows += [(300 + i, draw.randint(0, 2), rows[3][2]) for i in range(90)]
    rows += [rows[0], rows[0], (10, 2, [0] * 11), (20, 1, vector()), (20, 1, vector())]
    rows += [(None, 1, vector()), (7000, None, vector()), (7010, 1, None), (7020, 1, []), (-50, 0, vector())]
    want = brute(rows, 10)
    assert len(want) > 100 and found(spark, rows, 10, **sizes) == want


def test_few_rows(spark):
    assert found(spark, [], 1) == set()
    assert found(spark, [(1, 1, [3])], 1) == set()
    assert found(spark, [(1, 1, [10]), (2, 1, [10]), (3, 2, [9])], 1) == {(1, 2, 1, 3, 100, 90), (2, 1, 1, 3, 100, 90)}
    assert found(spark, [(1, 1, []), (2, 1, []), (3, 2, [])], 3) == set()
    with pytest.raises(ValueError, match="may not fit"):
        found(spark, [(1, 1, [1 << 40]), (2, 1, [1])], 1)
    with pytest.raises(ValueError, match="may not fit"):
        found(spark, [(1, 1, [-(1 << 63)]), (2, 1, [1])], 1)


def test_query(spark, sf_dir):
    name = "op13_hard_negatives"
    rows, problems = compare(entry.queries()[name](spark, sf_dir), connect(sf_dir), entry.oracle_sql()[name])
    assert rows > 0 and not problems


def test_query_leaves_odd_vectors_out(spark, tmp_path):
    numbers = [[1.0, 0.5], [0.9, 0.6], [0.8, 0.1], None, [None, 1.0], [float("nan"), 1.0], [float("-inf"), 1.0]]
    rows = [(50 * i, v, 1) for i, v in enumerate(numbers, 1)] + [(9, [0.75, 0.25], 2), (8, [0.5, 0.5], None)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(
        f"{folder}/embeddings.parquet"
    )
    got = entry.queries()["op13_hard_negatives"](spark, folder).collect()
    assert {r.anchor_id for r in got} == {50, 100, 150} and {r.negative_id for r in got} == {9}
