"""Exact top-k against brute force."""

import math
import random

import pytest

from skytrace.llm import topk

NAN, INF = float("nan"), float("inf")


def slow(rows, k=20):
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in {i: v for i, v in sorted(fine, key=lambda r: r[0])}.items():
        if q % 20:
            continue
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in fine if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("seed,bucket,block", [(1, 4096, 512), (2, 32, 7), (3, 16, 3)])
def test_against_brute_force(spark, seed, bucket, block):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        stretch = rng.choice([0.01, 0.3, 1, 8])  # lengths of all sizes, so that both prunings are used
        rows.append((i, [rng.gauss(0, 1) * stretch * (4 if j == i % 5 else 1) for j in range(12)]))
    rows += [(1000 + i, [0.5] * 12) for i in range(50)] + [(2000, None), (2020, [1.0, None]), (2040, [NAN] * 12), (2060, [INF] * 12), (2080, []), (2100, [0.0] * 12), (None, [1.0] * 12), (2120, [3.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "'x' AS norm", "2 AS block")
    exact = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    out = topk.top_k(df, "vec_id % 20 = 0", topk.RetrievalParams(bucket_rows=bucket, query_rows=block)).collect()
    assert sorted(tuple(r) for r in out) == slow(exact)


def test_large_components(spark):
    rows = [(0, [1e6, -1e6]), (20, [1e9, 1e9]), (1, [2.0**40, 5.0]), (2, [1e30, 0.0])]
    out = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0").collect()}
    assert out[(0, 1)] == 64000000 * 2**46 - 64000000 * 320 if 64000000 * 2**46 < 2**63 else out[(0, 1)] == 2**63 - 1
    assert out[(0, 20)] == 0 and out[(20, 2)] == 2**63 - 1


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, "vec_id % 20 = 0").collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(df.limit(0), "vec_id % 20 = 0").count() == 0
