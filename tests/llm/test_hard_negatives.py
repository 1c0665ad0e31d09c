"""Hard negatives against brute force, and the parts of the index on their own."""

import math
import random

import numpy as np
import pytest

from skytrace.llm import hard_negatives as hn

NAN, INF = float("nan"), float("inf")


def slow(rows, p=hn.MiningParams()):
    fine = [(i, [math.floor(p.scale * x) for x in v], l) for i, v, l in rows if None not in (i, v, l) and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, l in fine:
        if i % 50 == 0:
            anchors[i] = min(anchors.get(i, (v, l)), (v, l))
    out = []
    for a, (av, al) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, l) for i, v, l in fine if i != a)
        for s, positive, _ in [r for r in scored if r[2] == al][:p.positives]:
            negatives = [r for r in scored if r[2] != al and p.low * -s <= 100 * -r[0] <= p.high * -s][:p.negatives]
            out += [(a, positive, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(negatives)]
    return sorted(out)


def clustered(seed, n=400, width=12):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, 0.4) for x in c], rng.randrange(4)))
    rows += [(1000 + i, rows[50][1], i % 3) for i in range(40)]  # many equal vectors: ties
    rows += [(2000, None, 1), (2050, [1.0, None], 1), (2100, [NAN] * width, 1), (2150, [INF] * width, 1), (2200, [], 1), (2250, [0.0] * width, 2), (None, [1.0] * width, 1), (2300, [3.0, -2.0], 1), (2350, [1.0] * width, None)]
    rows += [(2400, [0.5] * width, 1), (2400, [0.4] * width, 2), (2400, [0.5] * width, 1)]
    return rows


@pytest.mark.parametrize("seed,p", [(1, hn.MiningParams()), (2, hn.MiningParams(codewords=4, sample=50, block_rows=64, anchor_rows=4, listed=2)), (3, hn.MiningParams(codewords=3, block_rows=7, anchor_rows=1, listed=5, rounds=1))])
def test_against_brute_force(spark, seed, p):
    df = spark.createDataFrame(clustered(seed), "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS score", "2 AS cell", "'x' AS v", "3 AS w", "4 AS norm")
    exact = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    out = sorted(tuple(r) for r in hn.mine(df, "vec_id % 50 = 0", p).collect())
    assert out == slow(exact, p) and len(out) > 50


def test_large_components_and_few_rows(spark):
    kind = "vec_id long, embedding array<double>, label int"
    rows = [(0, [1e6, 2e6], 1), (1, [1e6, 2e6], 1), (2, [0.9e6, 1.7e6], 2), (3, [2.0**40, 5.0], 3)]
    assert sorted(tuple(r) for r in hn.mine(spark.createDataFrame(rows, kind), "vec_id % 50 = 0").collect()) == slow(rows)
    for few in ([], rows[:1], [(0, None, 1)], [(0, [], 1), (1, [], 1), (2, [], 2)]):
        assert sorted(tuple(r) for r in hn.mine(spark.createDataFrame(few, kind), "vec_id % 50 = 0").collect()) == slow(few)


def test_walk_is_by_falling_sum():
    rng = np.random.default_rng(5)
    first, second = rng.normal(size=7), rng.normal(size=5)
    got = list(hn.walk(first, second))
    assert {(i, j) for _, i, j in got} == {(i, j) for i in range(7) for j in range(5)} and len(got) == 35
    sums = [s for s, _, _ in got]
    assert sums == sorted(sums, reverse=True) and all(abs(s - first[i] - second[j]) < 1e-12 for s, i, j in got)


def block_of(vectors, labels, books):
    width = vectors.shape[1]
    cells = hn.nearest_word(vectors[:, :width // 2].astype(float), books[0]) * len(books[1]) + hn.nearest_word(vectors[:, width // 2:].astype(float), books[1])
    order = np.argsort(cells, kind="stable")
    columns = [order.tolist(), [labels[i] for i in order], [vectors[i].tolist() for i in order], cells[order].tolist()]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["vec_id", "label", "v", "cell"])
    return next(hn._packed(iter([batch]), books, width, len(order))).to_pylist()[0]


def test_certified_windows_stop_early():
    """Well separated vectors: the walk scores a small part of the rows and still finds the right ones."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 1000
    vectors = (centres[rng.integers(40, size=4000)] + rng.normal(size=(4000, 16)) * 20).astype(np.int64)
    labels = rng.integers(5, size=4000).tolist()
    books = tuple(hn.fit_codebook(h.astype(float), 16, 8) for h in hn._halves(vectors))
    windows = [{"w": 0, "same": True, "k": 5, "low": hn.LEAST, "high": hn.MOST, "floor": hn.LEAST, "floor_id": hn.MOST}]
    anchors = [{"id": i, "label": labels[i], "v": vectors[i].tolist(), "windows": windows} for i in range(20)]
    found, scored = hn.search_block(anchors, block_of(vectors, labels, books), books, 16)
    want = []
    for a in anchors:
        rest = sorted((-int(vectors[i] @ vectors[a["id"]]), i) for i in range(4000) if i != a["id"] and labels[i] == a["label"])
        want += [(a["id"], 0, i, -s) for s, i in rest[:5]]
    assert sorted(found) == sorted(want) and scored < 0.2 * 20 * 4000


def test_bounds_hold():
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(500, 10)) * 300).astype(np.int64)
    books = tuple(hn.fit_codebook(h.astype(float), 4, 3) for h in hn._halves(vectors))
    block = block_of(vectors, [0] * 500, books)
    held, radii = np.array(block["held"]), np.array(block["radii"]).reshape(-1, 2).T
    total = sum(hn.bounds(vectors.astype(float), books, np.divmod(held, len(books[1])), radii))
    for cell, i in zip(block["cells"], block["ids"]):
        assert (vectors @ vectors[i] <= total[:, np.searchsorted(held, cell)]).all()
