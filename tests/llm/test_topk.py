"""Exact search against all inner products."""

import random

import pytest
from pyspark.sql import functions as F

from landshift.llm.topk import quantised, top_k


def brute(rows, k):
    import math

    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in ok if i % 10 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("size,rounds", [(300, 1 << 20), (300, 250), (1, 1 << 20), (7, 1 << 20)])
def test_like_brute_force(spark, size, rounds):
    rng = random.Random(size)
    rows = [(i, [rng.gauss(0, 1) * rng.choice([.1, 1, 5]) for _ in range(21)]) for i in range(size)]
    rows += [(i + 1000, rows[i][1]) for i in range(0, size, 3)]  # ties
    rows += [(11, rows[0][1])] * 2  # repeated rows of a candidate
    rows += [(20, [1.0, 2.0]), (30, [1.0, None, 2.0]), (40, None), (None, [1.0] * 21), (50, [float("nan")] * 21), (60, [float("inf")] * 21), (70, [])]
    df = spark.createDataFrame([(i, v, "q") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = top_k(quantised(df), F.col("vec_id") % 10 == 0, 10, rounds).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, 10)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(quantised(df), F.col("vec_id") % 10 == 0).collect() == []


def test_large_components(spark):
    rows = [(10, [3e6, -3e6, 1.0]), (1, [3e6, 3e6, 2.0]), (2, [-1.0, 2e6, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(quantised(df), F.col("vec_id") % 10 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, 10)
