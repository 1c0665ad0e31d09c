"""Closed-form and brute-force checks on small seeded fixtures."""

import math
import random
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import fixtures as fx
from skytrace import session
from skytrace.functions import kernels, special, vectors
from skytrace.functions.satellite import CHANNELS, Satellite, brightness_temperature, parallax, spectral_radiance
from skytrace.operators import aggregates, clustering, components, featurespace, filters, meanshift, neighbours, ordering, tracking, trackstats
from skytrace.operators.featurespace import Variable
from skytrace.params import DetectionParams, Grid, TrackingParams, filter_width_to_scale, scale_to_filter_width
from skytrace.plans.detection import detect
from skytrace.plans.tracking import track


# --- scalar functions ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("kernel", [kernels.gauss, kernels.epanechnikov, kernels.uniform])
@pytest.mark.parametrize("size", [0.5, 1.0, 100.0])
def test_kernels_fall_and_stay_positive(spark, kernel, size):
    df = spark.range(1000).select(F.col("id"), kernel(F.col("id").cast("double"), size).alias("k"))
    k = [r["k"] for r in df.orderBy("id").collect()]
    assert min(k) >= 0.0
    assert all(a >= b for a, b in zip(k, k[1:]))


def test_kernel_extremes(spark):
    row = spark.range(1).select(*[
        kernel(F.lit(d), 1.0).alias(f"{name}{i}") for name, kernel in kernels.KERNELS.items() if kernel
        for i, d in enumerate((0.0, 1e-300, 1e300))
    ]).first()
    assert all(v >= 0.0 for v in row)


def test_erfc(spark):
    xs = [-3.0, -0.5, 0.0, 0.1, 0.7, 1.0, 2.5, 5.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(special.erfc(F.col("x"))).collect()]
    for x, g in zip(xs, got):
        assert g == pytest.approx(math.erfc(x), rel=1e-14)
    edge = spark.range(1).select(special.relative_erfc(F.lit(5.0), F.lit(None).cast("double")), special.relative_erfc(F.lit(0.0), F.lit(0.0))).first()
    assert edge[0] == pytest.approx(0.0, abs=1e-12) and edge[1] == pytest.approx(1.0, abs=2e-7)


def test_text_forms(spark):
    df = spark.range(1)
    ids = F.array(*[F.lit(i).cast("bigint") for i in (3, 1, 4, 2)])
    entries = F.array(
        F.struct(F.lit(1).cast("bigint").alias("key"), F.array(F.lit(4).cast("bigint"), F.lit(3).cast("bigint")).alias("ids")),
        F.struct(F.lit(0).cast("bigint").alias("key"), F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")).alias("ids")),
    )
    s, m = df.select(vectors.set_to_text(ids).alias("s"), vectors.map_to_text(entries).alias("m")).first()
    assert s == "{1,2,3,4}"
    assert m == "[0:{1,2};1:{3,4};]"
    back = df.select(
        vectors.set_from_text(F.lit(s)).alias("s"), vectors.map_from_text(F.lit(m)).alias("m"), vectors.set_from_text(F.lit("{}")).alias("e"),
        vectors.vector_from_text(F.lit("(1.5,2,-3)")).alias("v"),
    ).first()
    assert back["s"] == [1, 2, 3, 4] and back["m"] == {0: [1, 2], 1: [3, 4]} and back["e"] == [] and back["v"] == [1.5, 2.0, -3.0]


def test_scale_conversions():
    assert scale_to_filter_width(32.0) == pytest.approx(math.sqrt(math.ceil(-64.0 * math.log(0.01))) / 2)
    assert filter_width_to_scale(3.0) == pytest.approx(-18.0 / math.log(0.01))


def test_satellite_round_trip(spark):
    for channel in CHANNELS:
        t = spark.range(1).select(brightness_temperature(spectral_radiance(F.lit(-20.0), channel), channel)).first()[0]
        assert t == pytest.approx(-20.0, abs=1e-6)


def test_parallax_ground_and_height(spark):
    sat = Satellite(42164.0, 0.0, 0.0)
    ground = spark.range(1).select(*parallax(F.lit(50.0), F.lit(10.0), F.lit(0.0), sat)).first()
    assert ground[0] == pytest.approx(50.0, abs=1e-3) and ground[1] == pytest.approx(10.0, abs=1e-3)
    high = spark.range(1).select(*parallax(F.lit(50.0), F.lit(10.0), F.lit(12.0), sat)).first()
    # a high cloud is really closer to the sub-satellite point than it looks
    assert 49.5 < high[0] < 50.0 and 9.5 < high[1] < 10.0


def test_projection_round_trip(spark):
    lat, lon = trackstats.to_geographic(F.lit(-200.0), F.lit(-4300.0))
    x, y = trackstats.to_stereographic(lat, lon)
    got = spark.range(1).select(x, y).first()
    assert got[0] == pytest.approx(-200.0, abs=1e-6) and got[1] == pytest.approx(-4300.0, abs=1e-6)


@pytest.mark.parametrize("sizes", [(5,), (5, 10), (5, 10, 15), (5, 10, 15, 20)])
def test_linear_index_is_a_bijection(spark, sizes):
    dims = tuple("dzyx"[-len(sizes):])
    grid = Grid(dims, sizes, (1.0,) * len(sizes), (0.0,) * len(sizes), ("m",) * len(sizes))
    df = spark.range(grid.cells).select("id", *[c.alias(d) for d, c in featurespace.grid_point(F.col("id"), grid).items()])
    back = df.select("id", *dims, featurespace.linear_index(grid).alias("back"))
    assert back.where("id <> back").count() == 0
    assert back.select(*dims).distinct().count() == grid.cells


# --- neighbourhoods -------------------------------------------------------------------------------------------


def _random_points(spark, grid, n, seed, scan=0):
    rng = np.random.default_rng(seed)
    index = np.unique(rng.integers(0, grid.sizes[0], (n, len(grid.dims))), axis=0)
    return fx.points_frame(spark, grid, index, rng.uniform(0, 3, len(index)), scan)


@pytest.mark.parametrize("dims", [1, 2, 3])
@pytest.mark.parametrize("h", [0.03, 0.11, 0.4])
def test_range_join_is_brute_force(spark, dims, h):
    grid = fx.square_grid(20, 1.0, dims)
    p = _random_points(spark, grid, 250, dims)
    cols = ["c_" + d for d in grid.dims] + ["v"]
    ranges = [h] * dims + [1.0]
    got = {(r["pid"], r["n_pid"]) for r in neighbours.ellipsoid_pairs(p, p, grid.reach((h,) * dims), cols, ranges).collect()}
    pdf = p.toPandas()
    x = pdf[cols].to_numpy() / np.array(ranges)
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    ids = pdf["pid"].to_numpy()
    want = {(ids[i], ids[j]) for i, j in zip(*np.where(d2 <= 1.0))}
    close = {(ids[i], ids[j]) for i, j in zip(*np.where(np.abs(d2 - 1.0) < 1e-9))}
    assert got - close == want - close


def test_nearest_is_brute_force(spark):
    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.normal(0, 0.1, (60, 2)), rng.uniform(-20, 20, (10, 2))])
    df = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "g int, i int, a double, b double")
    got = neighbours.nearest(df, df, 4, ["a", "b"], [1.0, 1.0], "i", "i", ("g",), start=0.05)
    rows = {(r["i"], r["rank"]): r["n_i"] for r in got.collect()}
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    assert len(rows) == 4 * len(xy)
    for i in range(len(xy)):
        want = sorted(range(len(xy)), key=lambda j: (d[i, j], j))[:4]
        assert [rows[i, k] for k in range(1, 5)] == want


def test_nearest_with_fewer_than_k(spark):
    df = spark.createDataFrame([(0, 0, 0.0), (0, 1, 9.0)], "g int, i int, a double")
    got = neighbours.nearest(df, df, 5, ["a"], [1.0], "i", "i", ("g",), start=0.5)
    assert {(r["i"], r["rank"], r["n_i"]) for r in got.collect()} == {(0, 1, 0), (0, 2, 1), (1, 1, 1), (1, 2, 0)}


# --- filters ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("symmetric", [True, False])
def test_scale_space_is_brute_force(spark, symmetric):
    grid = Grid(("y", "x"), (30, 41), (1.0, 1.0), (0.0, 0.0), ("km", "km"))
    rng = np.random.default_rng(3)
    index = np.unique(np.stack([rng.integers(0, 30, 200), rng.integers(0, 41, 200)], axis=1), axis=0)
    p = fx.points_frame(spark, grid, index, rng.uniform(1, 3, len(index)))
    scale = 6.0
    taps = filters.smoothing_taps(scale, 1.0)
    w = len(taps) - 1
    field = np.full(grid.sizes, np.nan)
    field[index[:, 0], index[:, 1]] = p.toPandas().sort_values("pid")["v"].to_numpy()
    original = ~np.isnan(field)
    for axis in (0, 1):
        new = np.full(grid.sizes, np.nan)
        n = grid.sizes[axis]
        for i in range(n):
            hi = min(i + w, n - 1)
            sources = range(max(i - w, 0), hi + 1 if symmetric else hi)
            for j in sources:
                line = np.take(field, j, axis=axis)
                seen = ~np.isnan(line)
                target = np.take(new, i, axis=axis)
                target = np.where(seen, np.where(np.isnan(target), 0.0, target) + taps[abs(i - j)] * np.where(seen, line, 0.0), target)
                new[(i, slice(None)) if axis == 0 else (slice(None), i)] = target
        field = new
    got = filters.scale_space(p, grid, ["v"], scale, symmetric).toPandas()
    dense = np.full(grid.sizes, np.nan)
    dense[got["y"], got["x"]] = got["v"]
    assert len(got) == (~np.isnan(field)).sum()
    np.testing.assert_allclose(dense, field, rtol=1e-12)
    if symmetric:
        flags = np.zeros(grid.sizes, bool)
        flags[got["y"], got["x"]] = got["is_original"]
        assert (flags == original).all()


def test_replacement_modes(spark):
    grid = Grid(("x",), (5,), (1.0,), (0.0,), ("m",))
    p = fx.points_frame(spark, grid, np.arange(5)[:, None], np.array([5.0, 1.0, 4.0, 2.0, 3.0]))
    run = lambda mode, share: [r["v"] for r in filters.replacement(p, grid, "v", mode, share, (2.0, 100.0), ["c_x", "v"]).orderBy("x").collect()]
    # neighbours within 2 (distance just below 1 with the value term): whole windows of up to five cells
    windows = [[5, 1], [5, 1, 4], [1, 4, 2], [4, 2, 3], [2, 3]]
    assert run("lowest", 0.5) == [min(w) if round(len(w) * 0.5) < 2 else sum(sorted(w)[:2]) / 2 for w in windows]
    assert run("highest", 0.34) == [max(w) for w in windows]
    assert run("median", 1.0) == [sorted(w)[len(w) // 2] for w in windows]


# --- mean-shift -------------------------------------------------------------------------------------------------


def _origin_shift(spark, grid, points, ranges, kernel=kernels.uniform, size=1.0, weight=None):
    centre = {d: (n - 1) // 2 for d, n in zip(grid.dims, grid.sizes)}
    at = points.where(" AND ".join(f"{d} = {i}" for d, i in centre.items()))
    out = meanshift.shift_vectors(at, grid, ["v"], ranges, kernel, size, weight, search=points, normalise=False).first()
    return [out["s_" + d] for d in grid.dims]


@pytest.mark.parametrize("dims,nodes", [(2, 100), (3, 24)])
def test_shift_vanishes_at_the_centre_of_shells(spark, dims, nodes):
    grid = fx.square_grid(nodes, 4.4, dims)
    index = np.indices(grid.sizes).reshape(dims, -1).T
    r = np.sqrt(((index * grid.resolution[0] + grid.origin[0]) ** 2).sum(axis=1))
    shells = np.any([np.abs(r - k) <= grid.resolution[0] / 2 for k in (0, 1, 2, 3, 4)], axis=0)
    p = fx.points_frame(spark, grid, index[shells], np.full(shells.sum(), 3.0))
    limit = grid.resolution[0] * math.sqrt(dims)
    for h in (1.0, 2.0):
        assert np.linalg.norm(_origin_shift(spark, grid, p, (h * 1.1,) * dims + (3.0,))) < limit


@pytest.mark.parametrize("dims,nodes", [(2, 100), (3, 20)])
def test_shift_vanishes_on_a_uniform_field(spark, dims, nodes):
    grid = fx.square_grid(nodes, 1.1, dims)
    index = np.indices(grid.sizes).reshape(dims, -1).T
    index = index[(index % 5 == 0).all(axis=1)]
    p = fx.points_frame(spark, grid, index, np.full(len(index), 3.0))
    for h in (0.5, 1.0):
        assert np.linalg.norm(_origin_shift(spark, grid, p, (h,) * dims + (3.0,))) < grid.resolution[0] * math.sqrt(dims)


@pytest.mark.parametrize("kernel", [kernels.gauss, kernels.epanechnikov])
def test_shift_vanishes_at_a_weighted_peak(spark, kernel):
    grid = fx.square_grid(50, 1.1, 2)
    index = np.indices(grid.sizes).reshape(2, -1).T
    c = index * grid.resolution[0] + grid.origin[0]
    p = fx.points_frame(spark, grid, index, 9.0 * np.exp(-(c ** 2).sum(axis=1))).withColumn("w", F.col("v"))
    assert np.linalg.norm(_origin_shift(spark, grid, p, (0.5, 0.5, 9.0), kernel, 1.0, "w")) < 1e-6


@pytest.mark.parametrize("seed", range(2))
def test_iteration_converges(spark, seed):
    grid = fx.square_grid(60, 1.0, 2)
    rng = np.random.default_rng(seed)
    index = np.unique(np.rint((rng.normal(0, 0.25, (2000, 2)) + 1.0) / grid.resolution[0]).astype(int).clip(0, 60), axis=0)
    c = index * grid.resolution[0] + grid.origin[0]
    p = fx.points_frame(spark, grid, index, 3.0 * np.exp(-(c ** 2).sum(axis=1))).withColumn("w", F.col("v"))
    seeds = spark.createDataFrame([(0, 1, 0.4, 0.3, 1.0), (0, 2, -0.3, -0.35, 1.0)], "scan bigint, seed int, c_y double, c_x double, v double")
    path = meanshift.iterate(seeds, p, grid, ["v"], (0.3, 0.3, 3.0), kernels.gauss, 1.0, "w", epsilon=0.01, max_iterations=200)
    ends = meanshift.iterate_end(path).collect()
    assert len(ends) == 2
    for e in ends:
        assert e["shift_norm"] < 0.01 and e["steps"] < 200 and math.hypot(e["c_y"], e["c_x"]) < 0.25


def test_iteration_is_brute_force(spark):
    grid = fx.square_grid(20, 1.0, 2)
    p = _random_points(spark, grid, 150, 8)
    pdf = p.toPandas()
    seeds = p.where("pid % 17 = 0").select("scan", F.col("pid").alias("seed"), "c_y", "c_x")
    path = meanshift.iterate(seeds, p, grid, [], (0.35, 0.35), None, 1.0, "v", epsilon=0.02, max_iterations=50)
    ends = {r["seed"]: (r["c_y"], r["c_x"]) for r in meanshift.iterate_end(path).collect()}
    xy, w = pdf[["c_y", "c_x"]].to_numpy(), pdf["v"].to_numpy()
    for seed, at in pdf[pdf.pid % 17 == 0].set_index("pid")[["c_y", "c_x"]].iterrows():
        x = at.to_numpy()
        for _ in range(50):
            near = (((xy - x) / 0.35) ** 2).sum(axis=1) <= 1.0
            step = (w[near, None] * xy[near]).sum(axis=0) / w[near].sum() - x
            x = x + step
            if np.linalg.norm(step) < 0.02:
                break
        assert ends[seed] == pytest.approx(tuple(x), abs=1e-9)


# --- components and clusters --------------------------------------------------------------------------------------


def test_components_across_tiles(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1400)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame([(a, b, a // 40, b // 40) for a, b in edges], "src bigint, dst bigint, src_tile bigint, dst_tile bigint")
    got = {r["node"]: r["label"] for r in components.connected_components(df).collect()}
    assert got == fx.components(edges)


def test_components_star_and_ring(spark):
    edges = [(5000, i) for i in range(300)] + [(6000 + i, 6000 + (i * 7 + 3) % 200) for i in range(200)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame([(a, b, a, b) for a, b in edges], "src bigint, dst bigint, src_tile bigint, dst_tile bigint")
    got = {r["node"]: r["label"] for r in components.connected_components(df).collect()}
    assert got == fx.components(edges)


def test_small_tiles_give_the_same_clusters(spark, sf_dir, monkeypatch):
    from skytrace.sources import tables as tb

    cells = tb.cells(spark, sf_dir)
    whole = detect(cells, tb.GRID, tb.VARIABLES, tb.DETECTION)
    monkeypatch.setattr(clustering, "TILE_CELLS", 36)
    tiled = detect(cells, tb.GRID, tb.VARIABLES, tb.DETECTION)
    pick = lambda d: {tuple(r) for r in d.members.select("gid", "cluster").collect()}
    assert pick(whole) == pick(tiled)


@pytest.mark.parametrize("dims,divisions,nodes,draws,share,minimum,expected", [(2, 3, 100, 1666, 1 / 3, 25, 4), (3, 4, 48, 1250, 0.25, 50, 27)])
def test_clouds_become_clusters(spark, dims, divisions, nodes, draws, share, minimum, expected):
    grid = fx.square_grid(nodes, 1.0, dims)
    cells = spark.createDataFrame(fx.cloud_cells(grid, divisions, 0.4 / divisions if dims == 2 else 0.3 / divisions, draws, 1))
    v = Variable("v", valid_min=0.0, valid_max=3.0)
    params = DetectionParams(("v",), kernel="gauss", ranges=(share,) * dims + (3.0,), min_cluster_size=minimum)
    found = detect(cells, grid, [v], params)
    assert found.clusters.count() == expected


def test_coalesce_is_a_fixpoint(spark):
    """A ridge of falling weights collapses onto its top; a separate hill stays."""
    grid = Grid(("y", "x"), (3, 30), (1.0, 1.0), (0.0, 0.0), ("km", "km"))
    index = np.array([(1, x) for x in range(20)] + [(1, x) for x in range(22, 28)])
    points = fx.points_frame(spark, grid, index, np.arange(len(index)) + 1.0).withColumn("w", F.col("v"))
    labels = points.select("gid", F.when(F.col("x") < 20, F.floor(F.col("x") / 4) * 4).otherwise(F.floor((F.col("x") - 22) / 3) * 3 + 22).cast("bigint").alias("cluster"))
    out = clustering.coalesce(labels, points, grid).join(points.select("gid", "x"), "gid").collect()
    left = {r["cluster"] for r in out if r["x"] < 20}
    right = {r["cluster"] for r in out if r["x"] >= 22}
    assert len(left) == 1 and len(right) == 1 and left != right


def test_coalesce_is_brute_force(spark):
    grid = Grid(("y", "x"), (12, 12), (1.0, 1.0), (0.0, 0.0), ("km", "km"))
    rng = np.random.default_rng(2)
    index = np.indices(grid.sizes).reshape(2, -1).T
    points = fx.points_frame(spark, grid, index, rng.permutation(len(index)) + 1.0).withColumn("w", F.col("v"))
    labels = points.select("gid", (F.floor(F.col("y") / 3) * 36 + F.floor(F.col("x") / 3) * 3).cast("bigint").alias("cluster"))
    got = {r["gid"]: r["cluster"] for r in clustering.coalesce(labels, points, grid).collect()}
    pdf = points.join(labels, "gid").toPandas()
    at = {(r.y, r.x): r.gid for r in pdf.itertuples()}
    weight, label = dict(zip(pdf.gid, pdf.w)), dict(zip(pdf.gid, pdf.cluster))
    while True:
        links = []
        for c in set(label.values()):
            own = max(weight[g] for g in label if label[g] == c)
            outside = [at[y + dy, x + dx] for (y, x), g in at.items() if label[g] == c for dy in (-1, 0, 1) for dx in (-1, 0, 1)
                       if (y + dy, x + dx) in at and label[at[y + dy, x + dx]] != c]
            if outside:
                best = max(outside, key=lambda g: weight[g])
                if weight[best] >= own:
                    links.append((c, label[best]))
        if not links:
            break
        to = fx.components(links)
        label = {g: to.get(c, c) for g, c in label.items()}
    assert got == label


def test_initiation_weight_by_name(spark, sf_dir):
    """The named score equals the score function on the same channels, the current ones by the coldest quarter."""
    from skytrace.functions.weights import initiation_weight
    from skytrace.plans import satellite
    from skytrace.sources import tables as tb

    channels = {
        "msevi_l15_ir_108": F.col("v_raw") * 1.5 + 40.0, "msevi_l15_wv_062": F.col("u_raw") * 0.08 + 1.0, "msevi_l15_ir_134": F.col("v_raw") * 0.5 + 50.0,
        "cband_radolan_rx": F.col("v_raw") * 1.0, "linet_oase_tl": F.greatest(F.col("u_raw") - 95.0, F.lit(0.0)),
    }
    cells = tb.cells(spark, sf_dir).where("v_raw <> 255").select("scan", "ts", "y", "x", *[c.alias(n + "_raw") for n, c in channels.items()])
    variables = [Variable(n, valid_min=0.0, valid_max=200.0) for n in channels]
    params = DetectionParams(tuple(channels), weight="oase-ci", ranges=(2.0, 2.0) + (200.0,) * 5, kernel="gauss", replace_zero_shifts=True, add_strongest_neighbour=True)
    found = detect(cells, tb.GRID, variables, params, comparison=cells.withColumn("scan", F.col("scan") + 1))
    plain = cells.select("scan", "y", "x", *[F.col(n + "_raw").alias(n) for n in channels])
    now = satellite.current(plain, tb.GRID, (2.0, 2.0))
    want = initiation_weight(found.points, tb.GRID, now, (2.0, 2.0), plain.withColumn("scan", F.col("scan") + 1))
    pick = lambda df: {(r["gid"], r["w"]) for r in df.select("gid", "w").collect()}
    assert pick(found.weighted) == pick(want) and found.clusters.count() > 0
    # compared with the scan before along its protoclusters: a detection inside the weight
    few, plain = cells.where("scan <= 3"), plain.where("scan <= 3")
    chained = replace(params, ci_compare_previous=True, ci_protocluster_scale=4.0, ci_protocluster_min_size=5)
    limits = [replace(v, valid_max=400.0) for v in variables]
    found, scans = detect(few, tb.GRID, limits, chained), few.select("scan", "ts").distinct()
    compared = satellite.compare_with_previous(plain, scans, tb.GRID, (2.0, 2.0), (0.0, 400.0), chained)
    assert pick(found.weighted) == pick(satellite.compared_weight(found.points, tb.GRID, compared, (2.0, 2.0)))
    assert found.weighted.where("scan > 1").agg(F.max("w")).first()[0] > 0


def test_forecast_follows_a_moving_cloud(spark):
    """A cloud that moves two cells a scan is compared with itself, not with what lay there before."""
    from skytrace.functions.weights import IR_108
    from skytrace.params import Grid
    from skytrace.plans import satellite

    grid = Grid(("y", "x"), (20, 30), (1.0, 1.0), (0.0, 0.0), ("km", "km"))
    rows = []
    for scan in (1, 2):
        for y in range(20):
            for x in range(30):
                inside = 6 <= y < 12 and 4 + 4 * scan <= x < 12 + 4 * scan
                rows.append((scan, scan * 900, y, x, (30.0 + scan if inside else 150.0), 2.0, 60.0))
    cells = spark.createDataFrame(rows, "scan bigint, ts bigint, y int, x int, msevi_l15_ir_108 double, msevi_l15_wv_062 double, msevi_l15_ir_134 double")
    params = DetectionParams((IR_108,), ci_protocluster_scale=0.5, ci_protocluster_min_size=4)
    c = satellite.compare_with_previous(cells.drop("ts"), cells.select("scan", "ts").distinct(), grid, (1.0, 1.0), (0.0, 140.0), params)
    before = {(r["y"], r["x"]): r[IR_108] for r in c.before.where("scan = 2").collect()}
    assert before and set(before.values()) == {31.0}
    assert {(y, x) for y, x in before} == {(y, x) for y in range(6, 12) for x in range(12, 20)}
    assert {r["pid"] for r in c.overlap.collect()} == {y * 30 + x for y in range(6, 12) for x in range(12, 16)}


# --- ordering and aggregates ----------------------------------------------------------------------------------


def test_numbering_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_PART", 50)
    keys = random.Random(1).sample(range(10 ** 9), 1000)
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = {r["k"]: r["i"] for r in ordering.number_rows(df, "k", "i").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}
    names = spark.createDataFrame([(f"scan-{k:09d}.nc",) for k in keys], "name string")
    got = [r["name"] for r in ordering.number_rows(names, "name", "i").orderBy("i").collect()]
    assert got == sorted(f"scan-{k:09d}.nc" for k in keys)


def test_medians(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(v)) for g, n in ((1, 1), (2, 2), (3, 501), (4, 1000)) for v in np.round(rng.exponential(3, n), 1)] + [(5, 7.0)] * 9
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: r["v"] for r in ordering.group_medians(df, "g", ["v"]).collect()}
    for g in got:
        assert got[g] == pytest.approx(float(np.median([v for k, v in rows if k == g])))
    assert len(got) == 5


@pytest.mark.parametrize("limit", [session.BROADCAST_ROWS, 0])
def test_medians_of_several_columns(spark, monkeypatch, limit):
    """One plan for all columns, of other types too, with broadcast and with salted lookups; NULLs count in no column."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", limit)
    rng = np.random.default_rng(3)
    rows = [(int(g), None if rng.random() < 0.3 else float(v), int(10 * v)) for g, v in zip(rng.integers(0, 3, 300), rng.normal(0, 5, 300))]
    rows += [(7, None, None), (7, None, 4), (8, None, None)]
    got = ordering.group_medians(spark.createDataFrame(rows, "g int, v double, u int"), "g", ["v", "u"]).collect()
    assert sorted(r["g"] for r in got) == [0, 1, 2, 7, 8]
    for r in got:
        for at, name in ((1, "v"), (2, "u")):
            want = [row[at] for row in rows if row[0] == r["g"] and row[at] is not None]
            assert r[name] == (pytest.approx(float(np.median(want))) if want else None)
    empty = ordering.group_medians(spark.createDataFrame([], "g int, v double"), "g", ["v"])
    assert empty.columns == ["g", "v"] and empty.isEmpty()


def test_rank_within(spark):
    rng = np.random.default_rng(7)
    rows = [(int(g), int(i), float(np.round(v, 1))) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 400), rng.exponential(2, 400)))]
    got = aggregates.rank_within(spark.createDataFrame(rows, "g int, i int, v double"), "g", "v", "i", "p").collect()
    for g in range(3):
        want = [i for _, i, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))]
        assert [r["i"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["p"])] == want


def test_rank_correlations(spark):
    rng = np.random.default_rng(9)
    pairs = [(rng.integers(0, 6, 25).tolist(), rng.integers(0, 6, 25).tolist()) for _ in range(20)] + [([1] * 25, list(range(25)))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<bigint>, b array<bigint>")
    for r in df.select("i", aggregates.kendall(F.col("a"), F.col("b")).alias("k"), aggregates.spearman(F.col("a"), F.col("b")).alias("s")).collect():
        a, b = pairs[r["i"]]
        assert r["k"] == pytest.approx(fx.kendall(a, b)) and r["s"] == pytest.approx(fx.spearman(a, b))


def test_histogram_edges(spark):
    values = [-0.1, 0.0, 0.12, 2.99, 3.0, 5.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(aggregates.histogram_bin(F.col("v"), 0.0, 3.0)).collect()]
    assert got == [None, 0, 1, 24, 24, 24]


# --- tracking -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_matching_is_greedy(spark, seed):
    rng = random.Random(seed)
    pairs = [(n, 100 + m, rng.choice([0.1, 0.2, 0.3, 0.4])) for n in range(25) for m in range(25) if rng.random() < 0.3]
    df = spark.createDataFrame([(1, n, m, s, 1.0, 60.0, True) for n, m, s in pairs],
                               "pair bigint, n bigint, m bigint, likelihood double, dr_m double, dt double, possible boolean")
    assert {(r["n"], r["m"]) for r in tracking.match(df).collect()} == fx.greedy(pairs)


def _scene(spark, blobs):
    """Members of rectangular clusters: {scan: [(y0, y1, x0, x1), ...]} with half-open ranges."""
    from skytrace.plans.detection import describe

    grid = Grid(("y", "x"), (60, 60), (1.0, 1.0), (0.0, 0.0), ("km", "km"))
    rows = []
    for scan, rects in blobs.items():
        for y0, y1, x0, x1 in rects:
            cluster = scan * grid.cells + y0 * 60 + x0
            rows += [(scan, y, x, cluster) for y in range(y0, y1) for x in range(x0, x1)]
    pdf = pd.DataFrame(rows, columns=["scan", "y", "x", "cluster"])
    pdf["pid"] = pdf.y * 60 + pdf.x
    pdf["gid"] = pdf.scan * grid.cells + pdf.pid
    pdf["c_y"], pdf["c_x"], pdf["v"] = pdf.y.astype(float), pdf.x.astype(float), 1.0
    pdf["mode_src_v"] = 1.0
    members = spark.createDataFrame(pdf)
    clusters = describe(members, grid, ["v"], members.limit(0))
    return grid, members, clusters


def _track(spark, blobs, params=TrackingParams(), times=None):
    grid, members, clusters = _scene(spark, blobs)
    scans = spark.createDataFrame([(s, (times or {}).get(s, s * 300)) for s in blobs], "scan bigint, ts bigint")
    t = track(clusters, members, scans, grid, params)
    ids = {(r["scan"], r["first_pid"]): r["id"] for r in t.tracked.collect()}
    events = {(r["scan"], r["kind"], r["id"], tuple(r["related"])) for r in t.events.collect()}
    return ids, events, t


def test_a_moving_cluster_keeps_its_id(spark):
    blobs = {s: [(10 + s, 16 + s, 10 + s, 16 + s), (40, 44, 40, 44)] for s in range(5)}
    ids, events, t = _track(spark, blobs)
    assert {ids[s, (10 + s) * 60 + 10 + s] for s in range(5)} == {1}
    assert {ids[s, 40 * 60 + 40] for s in range(5)} == {2}
    moved = t.tracked.where("id = 1 AND step > 0").select("d_y", "d_x").distinct().collect()
    assert [tuple(r) for r in moved] == [(1.0, 1.0)]
    assert {e[1] for e in events if e[0] > 0} == {"tracked"}


def test_new_and_dropped(spark):
    ids, events, _ = _track(spark, {0: [(0, 5, 0, 5)], 1: [(40, 45, 40, 45)]})
    assert ids[0, 0] == 1 and ids[1, 40 * 60 + 40] == 2
    assert (1, "dropped", 1, ()) in events and (1, "new", 2, ()) in events


def test_gap_starts_a_new_segment(spark):
    blobs = {0: [(5, 10, 5, 10)], 1: [(5, 10, 5, 10)], 2: [(5, 10, 5, 10)]}
    ids, events, t = _track(spark, blobs, times={0: 0, 1: 300, 2: 2000})
    assert ids[0, 305] == ids[1, 305] == 1 and ids[2, 305] == 2
    assert [r["linked"] for r in t.pairs.orderBy("ts").collect()] == [False, True, False]


def test_merge(spark):
    """Two clusters grow into one; it matches the larger, the merge event names both."""
    ids, events, _ = _track(spark, {0: [(10, 16, 10, 20), (10, 16, 21, 27)], 1: [(10, 16, 10, 27)]})
    assert ids[1, 10 * 60 + 10] == 1
    assert (1, "merge", 1, (1, 2)) in events and (1, "dropped", 2, ()) in events


def test_split(spark):
    ids, events, _ = _track(spark, {0: [(10, 16, 10, 27)], 1: [(10, 16, 10, 20), (10, 16, 21, 27)]})
    assert ids[1, 10 * 60 + 10] == 1 and ids[1, 10 * 60 + 21] == 2
    assert (1, "split", 1, (1, 2)) in events


def test_merge_without_match_continues_the_largest_part(spark):
    """Sizes differ too much for a match; the part that covers most of the result passes its id on."""
    params = TrackingParams(max_size_deviation=0.0)
    ids, events, _ = _track(spark, {0: [(10, 16, 10, 24), (10, 16, 25, 28)], 1: [(10, 16, 10, 28)]}, params)
    assert ids[1, 10 * 60 + 10] == 1
    assert (1, "merge", 1, (1, 2)) in events and (1, "tracked", 1, ()) in events
    # the number drawn for the merged cluster (3) is used up but appears nowhere
    assert not any(e[1] == "new" and e[0] == 1 for e in events)
    off = TrackingParams(max_size_deviation=0.0, continue_ids=False)
    ids, events, _ = _track(spark, {0: [(10, 16, 10, 24), (10, 16, 25, 28)], 1: [(10, 16, 10, 28)]}, off)
    assert ids[1, 10 * 60 + 10] == 3 and (1, "merge", 3, (1, 2)) in events


def test_split_without_match_continues_in_the_largest_part(spark):
    params = TrackingParams(max_size_deviation=0.0)
    ids, events, _ = _track(spark, {0: [(10, 16, 10, 28)], 1: [(10, 16, 10, 24), (10, 16, 25, 28)]}, params)
    assert ids[1, 10 * 60 + 10] == 1
    assert any(e[1] == "split" and e[2] == 1 and len(e[3]) == 2 for e in events)


def test_overlap_constraint(spark):
    """A cluster too wide to move off its own area must be overlapped to continue."""
    far = {0: [(0, 40, 0, 10)], 1: [(0, 40, 11, 21)]}
    # radius about 10.6 km; 11 km in 300 s is within the speed limit, but half the reach is only 6 km
    loose = TrackingParams(max_velocity=40.0, use_overlap_constraint=False)
    tight = TrackingParams(max_velocity=40.0)
    assert _track(spark, far, loose)[0][1, 11] == 1
    assert _track(spark, far, tight)[0][1, 11] == 2
    # with a larger reach no overlap is asked for
    assert _track(spark, far, TrackingParams(max_velocity=80.0))[0][1, 11] == 1


def test_long_chains_resolve(spark):
    blobs = {s: [(5, 9, 5, 9)] for s in range(40)}
    ids, _, t = _track(spark, blobs)
    assert set(ids.values()) == {1}
    assert t.ids.count() == 40


# --- statistics -------------------------------------------------------------------------------------------------------


def test_class_histogram_overflow(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 5.0, 5.1, 10.0, 11.0, 99.0)], "v double")
    got = {r["class"]: r["n"] for r in trackstats.class_histogram(df, "v", (5, 10, 15)).collect()}
    assert got == {5.0: 2, 10.0: 2, 15.0: 1, None: 1}


def test_linked_nodes_levels(spark):
    links = spark.createDataFrame([(1, 2, 0), (2, 3, 1), (3, 4, 0), (4, 5, 2), (5, 6, 0)], "source bigint, target bigint, type int")
    roots = spark.createDataFrame([(7, 1)], "root bigint, uuid bigint")
    level = lambda m: {r["uuid"]: r["level"] for r in trackstats.linked_nodes(links, roots, m).collect()}
    assert level(0) == {1: 0, 2: 0, 3: 1}
    assert level(1) == {1: 0, 2: 0, 3: 1, 4: 1, 5: 2}
    assert level(9) == {1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2}


def test_linked_nodes_rounds_do_not_follow_the_track(spark, monkeypatch):
    """A chain of 2,000 steps with a merge at its end: the number of stored tables stays a few dozen."""
    from skytrace import session
    from skytrace.operators import tracking

    stored = []
    count = lambda df: stored.append(1) or session.store(df)
    monkeypatch.setattr(trackstats, "store", count)
    monkeypatch.setattr(tracking, "store", count)
    rows = [(i, i + 1, 0) for i in range(2000)] + [(2000, 5000, 1), (5000, 5001, 0)]
    links = spark.createDataFrame(rows, "source bigint, target bigint, type int")
    got = {r["uuid"]: r["level"] for r in trackstats.linked_nodes(links, spark.createDataFrame([(1, 7)], "root bigint, uuid bigint"), 1).collect()}
    assert got == {**{i: 0 for i in range(2001)}, 5000: 1, 5001: 1}
    assert len(stored) < 20


def test_previous_in_time(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), t) for t in rng.sample(range(10 ** 6), 300)]
    df = spark.createDataFrame(rows, "k int, ts bigint")
    got = {(r["k"], r["ts"]): r["prev_ts"] for r in trackstats.previous_in_time(df, "k", "ts", ["ts"], width=5000).collect()}
    for k in range(3):
        mine = sorted(t for q, t in rows if q == k)
        assert [got[k, t] for t in mine] == [None, *mine[:-1]]
