"""The plans used beyond the size limits give the same results, and range joins plan as equi-joins."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from skytrace import session
from skytrace.catalog.base import World
from skytrace.functions import kernels
from skytrace.operators import clustering, meanshift, neighbours, ordering
from skytrace.plans import satellite
from skytrace.plans.detection import detect
from skytrace.plans.tracking import track
from skytrace.sources import files, sinks
from skytrace.sources import tables as tb


def _plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _run(spark, sf_dir):
    cells = tb.cells(spark, sf_dir)
    d = detect(cells, tb.GRID, tb.VARIABLES, tb.DETECTION)
    t = track(d.clusters, d.members, cells.select("scan", "ts").distinct(), tb.GRID, tb.TRACKING)
    return (
        {(r["cluster"], r["id"], r["uuid"], r["has_margin"], round(r["radius_m"], 6)) for r in t.tracked.collect()},
        {(r["scan"], r["kind"], r["id"], tuple(r["related"])) for r in t.events.collect()},
    )


def test_large_table_plans_agree(spark, sf_dir, no_broadcast, monkeypatch):
    normal = _run(spark, sf_dir)
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ordering, "ROWS_PER_PART", 20)
    assert _run(spark, sf_dir) == normal


def test_kept_tables_of_many_rows_are_not_broadcast(spark, monkeypatch):
    """A broadcast is chosen by the files' size, which says little about packed numbers."""
    rows = spark.range(2000).select(F.col("id").alias("cluster"), (F.col("id") * 3).alias("uuid"))
    few = session.keep(rows.limit(20))
    monkeypatch.setattr(session, "BROADCAST_ROWS", 1000)
    many, big = session.keep(rows), session.cut(rows)
    assert session.row_count(many) == 2000
    for how in ("inner", "left", "left_anti"):
        out = big.join(many.where("uuid >= 0").select("cluster"), "cluster", how)
        assert "Broadcast" not in _plan(out) and out.count() == (0 if how == "left_anti" else 2000)
    assert "BroadcastHashJoin" in _plan(big.join(few, "cluster"))
    # a counted lookup out of such a table is still broadcast
    small = session.keep(many.where("cluster < 20"))
    assert "BroadcastHashJoin" in _plan(session.attach(many, small, ["cluster"], "uuid", part_of=small))


def test_published_clusters_of_many_rows_are_not_broadcast(spark, tmp_path, monkeypatch):
    clusters = spark.range(2000).select(F.lit(1).cast("bigint").alias("scan"), F.col("id").alias("cluster"), (F.col("id") + 7).alias("id"))
    sinks.write_clusters(str(tmp_path), clusters, clusters.withColumn("gid", F.col("cluster")), clusters.limit(5))
    monkeypatch.setattr(session, "BROADCAST_ROWS", 1000)
    read, members, events = files.read_clusters(spark, str(tmp_path))
    out = members.select("cluster", "gid").join(read.select("cluster", "id"), "cluster")
    assert "Broadcast" not in _plan(out) and out.count() == 2000
    assert "BroadcastHashJoin" in _plan(session.cut(members).join(events.select("cluster"), "cluster"))


def test_channels_of_many_cells_are_not_broadcast(spark, monkeypatch):
    rows = [(1, y, x, 60.0 + y, 50.0 + x, 40.0) for y in range(6) for x in range(6)]
    cells = spark.createDataFrame(rows, "scan bigint, y int, x int, " + ", ".join(c + " double" for c in satellite.SCORED))
    monkeypatch.setattr(session, "BROADCAST_ROWS", 10)
    now = satellite.current(cells, tb.GRID, (2.0, 2.0))
    out = session.cut(cells.select("scan", "y", "x")).join(now, ["scan", "y", "x"], "left")
    assert "Broadcast" not in _plan(out) and out.count() == 36


def test_blocks_copy_few_rows(spark, monkeypatch):
    for reach, most in (({"y": 1, "x": 1}, 1.5), ({"y": 2, "x": 2}, 1.8), ({"z": 2, "y": 2, "x": 2}, 6.0), ({"y": 9, "x": 9}, 4.0)):
        copies = 1.0
        for d, side in neighbours.block_sides(reach).items():
            copies *= (side + 2 * reach[d]) / side
        assert copies <= most
    rows = [(1, y, x, 30 * y + x) for y in range(-3, 16) for x in range(30)]
    points = spark.createDataFrame(rows, "scan bigint, y int, x int, gid bigint")
    pairs = lambda: {(r["gid"], r["n_gid"]) for r in neighbours.near_pairs(points, points, {"y": 2, "x": 1}).collect()}
    got = pairs()
    assert got == {(a[3], b[3]) for a in rows for b in rows if abs(a[1] - b[1]) <= 2 and abs(a[2] - b[2]) <= 1}
    monkeypatch.setattr(neighbours, "BLOCK_CELLS", 16)
    assert pairs() == got


def test_cells_are_derived_once(spark, sf_dir):
    world = World(spark, sf_dir)
    for table in (world.points, world.weighted, world.cells.where("v_raw = 255")):
        assert "l_suppkey" not in _plan(table) and "Exchange" not in _plan(table)
    assert world.cells.exceptAll(tb.cells(spark, sf_dir)).isEmpty() and world.cells.count() == tb.cells(spark, sf_dir).count()


def test_axes_are_looked_up(spark, no_broadcast):
    members = spark.createDataFrame([(1, 4, 2, 5, 2.0, 5.0), (1, 9, 7, 7, 7.0, 7.0)], "scan bigint, gid bigint, y int, x int, c_y double, c_x double")
    axis = spark.createDataFrame([("y", 2, 20.5), ("x", 5, 50.5), ("x", 7, 70.5)], "dim string, idx int, coord double")
    out = sinks.replace_axes(session.cut(members), axis, ("y", "x"))
    assert "SortMergeJoin" not in _plan(out)
    assert sorted((r["gid"], r["c_y"], r["c_x"]) for r in out.collect()) == [(4, 20.5, 50.5), (9, 7.0, 70.5)]


def test_small_clusters_leave_before_values_are_joined(spark):
    """Rows may repeat: a point told twice counts twice, before and after."""
    rows = [(1, g, g < 14, float(g)) for g in (1, 2, 2, 11, 12, 13, 14, 21)]
    shifts = spark.createDataFrame(rows, "scan bigint, gid bigint, is_original boolean, v double")
    labels = spark.createDataFrame([(1, 1), (2, 1), (11, 11), (12, 11), (13, 11), (14, 11), (21, 21)], "gid bigint, cluster bigint")
    order = lambda df: sorted(map(tuple, df.select("gid", "cluster", "v").collect()))
    for minimum in (2, 3, 4):
        kept = clustering.large_labels(labels, shifts, minimum)
        want = clustering.at_least(clustering.finalise(labels, shifts), minimum)
        assert order(clustering.finalise(kept, shifts)) == order(want)


def test_iterations_deal_their_points_out_once(spark, monkeypatch):
    rows = [(1, y, x, float(y), float(x), 1.0 + (y == 3)) for y in range(6) for x in range(6)]
    points = spark.createDataFrame(rows, "scan bigint, y int, x int, c_y double, c_x double, w double")
    seeds = points.select("scan", (F.col("y") * 6 + F.col("x")).alias("seed"), "c_y", "c_x")
    plans = []
    monkeypatch.setattr(meanshift, "cut", lambda df: plans.append(_plan(df)) or session.cut(df))
    path = meanshift.iterate(seeds, points, tb.GRID, [], (2.0, 2.0), kernels.gauss, 1.0, "w", max_iterations=3)
    assert path.where("step > 0").count() > 36 and len(plans) > 2
    assert all("InMemoryTableScan" in p for p in plans[1:])


def test_shift_plan(spark, sf_dir, no_broadcast):
    points = tb.cells(spark, sf_dir).select("scan", "y", "x", F.col("y").cast("double").alias("c_y"), F.col("x").cast("double").alias("c_x"), F.lit(1.0).alias("w"))
    points = points.withColumn("v", F.lit(1.0))
    out = meanshift.shift_vectors(points, tb.GRID, ["v"], (2.0, 2.0, 1.0), kernels.gauss, 1.0, "w")
    plan = _plan(out)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # two shuffles for the grid derivation, two for the join; the aggregation reuses the join's partitioning
    join = plan[: plan.index("SortMergeJoin")]
    assert "Exchange" not in join


def test_filters_reach_the_scan(spark, sf_dir):
    plan = _plan(tb.table(spark, sf_dir, "lineitem").where("l_suppkey = 3").select("l_quantity"))
    assert "PushedFilters: [IsNotNull(l_suppkey), EqualTo(l_suppkey,3)]" in plan
    cells = _plan(tb.cells(spark, sf_dir))
    assert "l_orderkey" not in cells and "l_returnflag" not in cells


def test_long_tracks_are_split_into_documents(spark):
    rows = [(7, s, s + 1, [float(s)], [float(s + 1)]) for s in range(25)] + [(8, 3, 99, [0.0], [1.0])]
    df = spark.createDataFrame(rows, "id bigint, step bigint, uuid bigint, min array<double>, max array<double>")
    docs = sinks.dictionary_rows(df, ["v"], steps=10).select("part", F.from_json("json", "id bigint, length bigint, part bigint, clusters array<struct<step: bigint>>, min array<double>, max array<double>").alias("d"))
    got = sorted((r["part"], r["d"]["length"], [c["step"] for c in r["d"]["clusters"]], r["d"]["min"], r["d"]["max"]) for r in docs.collect())
    assert got == [(p, 25, list(range(10 * p, min(10 * p + 10, 25))), [0.0], [25.0]) for p in range(3)]
