"""Searches by a metric partition: brute force, and how many candidates are looked at."""

import numpy as np
import pytest

from skytrace.operators import metric

DIM = 12
COLUMNS = [f"e{i}" for i in range(DIM)]


def clustered(spark, n, seed=0, centres=40, spread=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, DIM)) * 3
    m = middle[rng.integers(centres, size=n)] + rng.normal(size=(n, DIM)) * spread
    m[: n // 20] = m[0]  # many equal rows
    g = (rng.random(n) < 0.3).astype(int)
    return m, g, spark.createDataFrame([(i, int(g[i]), *map(float, m[i])) for i in range(n)], "i long, g int, " + ", ".join(f"{c} double" for c in COLUMNS))


def slow(m, g, band):
    for i in range(len(m)):
        d = np.sqrt((((m - m[i]) / band) ** 2).sum(axis=1))
        yield i, sorted((d[j], j) for j in range(len(m)) if g[j] == g[i])


@pytest.mark.parametrize("k", [1, 5])
def test_nearest_is_brute_force(spark, k):
    m, g, df = clustered(spark, 400, seed=k)
    got = {(r["i"], r["rank"]): (r["n_i"], r["distance"]) for r in metric.nearest(df, df, k, COLUMNS, [0.5] * DIM, "i", "i", ("g",)).collect()}
    assert len(got) == 400 * k
    for i, near in slow(m, g, 0.5):
        for rank in range(k):
            assert got[(i, rank + 1)][1] == pytest.approx(near[rank][0], abs=1e-9)
    # equal distances go to the smaller key
    assert [got[(0, r + 1)][0] for r in range(k)] == [j for d, j in next(slow(m, g, 0.5))[1] if d == 0][:k]


def test_within_is_brute_force(spark):
    m, g, df = clustered(spark, 400, seed=9, spread=0.3)
    got = {(r["i"], r["n_i"]) for r in metric.within(df, df, 3.0, COLUMNS, [0.5] * DIM, "i", "i", ("g",)).select("i", "n_i").collect()}
    assert got == {(i, j) for i, near in slow(m, g, 0.5) for d, j in near if d <= 3.0} and len(got) > 1000


def test_candidates_are_few_on_clustered_vectors(spark):
    _, _, df = clustered(spark, 3000, seed=4)
    refs = metric.references(df, COLUMNS)
    x = metric.store(metric.placed(df, COLUMNS, refs))
    regions = metric.regions_of(x, ["g"])
    asked = metric.first_radius(x, x, regions, 6, COLUMNS, "i", "i", ["g"])
    count = metric.candidates(asked, metric._named(x, ["g"], "i"), regions, ["g"], "i").count()
    assert 6 * 3000 <= count < 0.1 * 3000 ** 2


def test_small_and_empty_tables(spark):
    _, _, df = clustered(spark, 40, seed=2)
    for few, want in ((df.limit(0), 0), (df.where("i = 3"), 1), (df.where("i IN (3, 4) AND g >= 0"), None)):
        rows = metric.nearest(few, few, 5, COLUMNS, [1.0] * DIM, "i", "i", ("g",)).collect()
        assert want is None or len(rows) == want
        assert all(r["rank"] <= 5 for r in rows)
    left, right = df.where("i < 10"), df.where("i >= 30")
    out = metric.nearest(left, right, 2, COLUMNS, [1.0] * DIM, "i", "i", ("g",)).collect()
    assert {r["n_i"] for r in out} <= set(range(30, 40))


def unclustered(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, DIM))
    m /= np.sqrt((m * m).sum(axis=1))[:, None]
    g = np.zeros(n, int)
    return m, g, spark.createDataFrame([(i, 0, *map(float, m[i])) for i in range(n)], "i long, g int, " + ", ".join(f"{c} double" for c in COLUMNS))


def searched(df):
    refs = metric.references(df, COLUMNS)
    x = metric.store(metric.placed(df, COLUMNS, refs))
    return x, metric.regions_of(x, ["g"])


def test_unclustered_vectors_leave_their_neighbours_only(spark):
    """The triangle inequality leaves out hardly any region here: pairs must not leave the search one by one for that."""
    _, _, df = unclustered(spark, 2000)
    x, regions = searched(df)
    asked = metric.first_radius(x, x, regions, 6, COLUMNS, "i", "i", ["g"])
    count = metric.candidates(asked, metric._named(x, ["g"], "i"), regions, ["g"], "i").count()
    assert 6 * 2000 <= count < 0.02 * 2000 ** 2


def test_range_search_returns_only_pairs_within_the_radius(spark):
    m, _, df = unclustered(spark, 1500, seed=3)
    x, regions = searched(df)
    pairs = metric.candidates(x.withColumn("_radius", metric.F.lit(0.6)), metric._named(x, ["g"], "i"), regions, ["g"], "i")
    want = int((((m[:, None] - m[None]) ** 2).sum(axis=2) <= 0.36).sum())
    assert pairs.count() == want and want < 0.1 * 1500 ** 2


def test_range_search_over_many_blocks_repeated_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(metric, "BLOCK_ROWS", 40)
    m, g, df = clustered(spark, 400, seed=5, spread=0.3)
    key = lambda i: None if i < 3 else f"k{i % 150}"
    texts = df.withColumn("i", metric.F.when(metric.F.col("i") >= 3, metric.F.concat(metric.F.lit("k"), metric.F.col("i") % 150)))
    alone = texts.limit(1).withColumn("g", metric.F.lit(None).cast("int"))
    both = texts.unionByName(alone)
    got = sorted((r["g"], r["i"] or "", r["n_i"] or "") for r in metric.within(both, both, 3.0, COLUMNS, [0.5] * DIM, "i", "i", ("g",)).collect())
    assert got == sorted((int(g[i]), key(i) or "", key(j) or "") for i, near in slow(m, g, 0.5) for d, j in near if d <= 3.0)


def test_a_vector_travels_once_for_every_block_it_visits(spark, monkeypatch):
    """Before, a row was copied for each region and ring: over a hundred times here."""
    monkeypatch.setattr(metric, "BLOCK_ROWS", 500)
    sizes, search = [], metric._pairs

    def counted(left, right, on, left_key, k):
        sizes.append((left.count(), left.select("_row", "_visit").distinct().count()))
        return search(left, right, on, left_key, k)

    monkeypatch.setattr(metric, "_pairs", counted)
    _, _, df = unclustered(spark, 2000, seed=6)
    assert metric.nearest(df, df, 1, COLUMNS, [1.0] * DIM, "i", "i", ("g",)).count() == 2000
    assert [n for n, _ in sizes] == [n for _, n in sizes] and sizes[0][0] == 2000 and sizes[1][0] <= 2000 * 4


@pytest.mark.parametrize("k", [1, 6])
def test_nearest_over_many_blocks(spark, monkeypatch, k):
    monkeypatch.setattr(metric, "BLOCK_ROWS", 30)
    m, g, df = clustered(spark, 500, seed=7)
    got = {(r["i"], r["rank"]): (r["n_i"], r["distance"]) for r in metric.nearest(df, df, k, COLUMNS, [0.5] * DIM, "i", "i", ("g",)).collect()}
    assert len(got) == 500 * k
    for i, near in slow(m, g, 0.5):
        for rank in range(k):
            assert got[(i, rank + 1)][1] == pytest.approx(near[rank][0], abs=1e-9)
        if near[k - 1][0] == 0:
            assert [got[(i, r + 1)][0] for r in range(k)] == [j for _, j in near[:k]]


def test_searched_rows_are_copied_for_few_blocks_of_searching_rows(spark, monkeypatch):
    """Regions on the border of two blocks sent every block to three others, twice for the nearest, as soon as a group had several blocks."""
    monkeypatch.setattr(metric, "BLOCK_ROWS", 100)
    copies, search = [], metric._pairs

    def counted(left, right, on, left_key, k):
        cells = left.select(*on, "_block", "_visit").distinct()
        copies.append(right.join(cells, [*on, "_visit"]).count())
        return search(left, right, on, left_key, k)

    monkeypatch.setattr(metric, "_pairs", counted)
    _, _, df = clustered(spark, 2000, seed=8)
    assert metric.nearest(df, df, 1, COLUMNS, [1.0] * DIM, "i", "i", ("g",)).count() == 2000
    assert len(copies) == 2 and max(copies) <= 1.6 * 2000
    metric.within(df, df, 100.0, COLUMNS, [1.0] * DIM, "i", "i", ("g",)).count()
    assert copies[2] <= 2000 * 2000 / 300
