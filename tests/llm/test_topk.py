"""Exact top-k against brute force."""

from __future__ import annotations

import math
import random

import pytest

from tessera.llm import topk


def brute(rows, every, k):
    clean = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = set()
    for i, q in clean:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x, strict=False)), j) for j, x in clean if j != i)[:k]
            out |= {(i, n, j, -s) for n, (s, j) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("kind", ["ties", "spread"])
def test_against_brute_force(spark, tmp_path, kind):
    r = random.Random(3)
    draw = (lambda: float(r.randint(-1, 1))) if kind == "ties" else (lambda: r.gauss(0, 1) * 10 ** r.randint(-2, 2))
    rows = [(i, [draw() for _ in range(r.choice([3, 4]))]) for i in range(1, 240)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf")]), (None, [1.0]), (304, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS part")
    got = topk.top_k(df, str(tmp_path / "index"), every=20, k=5, pivots=7, part_rows=40, tile_queries=5).collect()
    assert {tuple(x) for x in got} == brute(rows, 20, 5)


def test_small_tables(spark, tmp_path):
    df = spark.createDataFrame([(0, [1.0]), (100, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, str(tmp_path / "a")).collect())) == [(0, 1, 100, 2097152), (100, 1, 0, 2097152)]
    assert topk.top_k(df.limit(0), str(tmp_path / "b")).count() == 0


def test_repeated_query_rows(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(3)]) for i in range(1, 120)]
    for times in (2, 5):
        more = rows + [x for x in rows if x[0] % 20 == 0] * (times - 1)
        df = spark.createDataFrame(more, "vec_id long, embedding array<double>")
        got = [tuple(x) for x in topk.top_k(df, str(tmp_path / str(times)), every=20, k=10, pivots=5, part_rows=60).collect()]
        assert len(got) == 50 and set(got) == brute(more, 20, 10)
