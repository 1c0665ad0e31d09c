"""Batches must give what one run over everything gives."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from skytrace.params import TrackingParams
from skytrace.plans.detection import detect
from skytrace.plans.incremental import advance
from skytrace.plans.tracking import track
from skytrace.sources import tables as tb
from skytrace.streaming import runner


@pytest.fixture(scope="module")
def whole(spark, sf_dir):
    cells = tb.cells(spark, sf_dir)
    d = detect(cells, tb.GRID, tb.VARIABLES, tb.DETECTION)
    t = track(d.clusters, d.members, cells.select("scan", "ts").distinct(), tb.GRID, tb.TRACKING)
    return cells, {(r["cluster"], r["id"], r["uuid"]) for r in t.tracked.collect()}, {
        (r["scan"], r["kind"], r["id"], tuple(r["related"])) for r in t.events.collect()}


def _stored(spark, out):
    tracked = {(r["cluster"], r["id"], r["uuid"]) for r in spark.read.parquet(f"{out}/clusters").collect()}
    events = {(r["scan"], r["kind"], r["id"], tuple(r["related"])) for r in spark.read.parquet(f"{out}/events").collect()}
    return tracked, events


def test_batches_equal_one_run(spark, whole, tmp_path):
    cells, tracked, events = whole
    out = str(tmp_path / "out")
    for batch, (lo, hi) in enumerate([(0, 3), (4, 4), (5, 99)]):
        part = cells.where(F.col("scan").between(lo, hi))
        advance(spark, part, out, batch, tb.GRID, tb.VARIABLES, tb.DETECTION, tb.TRACKING)
        if batch == 1:  # a repeated batch replaces itself
            advance(spark, part, out, batch, tb.GRID, tb.VARIABLES, tb.DETECTION, tb.TRACKING)
    # a late scan is rejected
    advance(spark, cells.where("scan = 2"), out, 3, tb.GRID, tb.VARIABLES, tb.DETECTION, tb.TRACKING)
    assert _stored(spark, out) == (tracked, events)


def test_stream_equals_one_run(spark, whole, tmp_path):
    cells, tracked, events = whole
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    stored = cells.withColumns({"v_raw": F.col("v_raw").cast("double"), "u_raw": F.col("u_raw").cast("double")})
    for scan in range(0, 10, 5):
        stored.where(F.col("scan").between(scan, scan + 4)).coalesce(1).write.mode("append").parquet(source)
    query = runner.start(spark, source, out, tb.GRID, tb.VARIABLES, tb.DETECTION, tb.TRACKING, files_per_batch=1)
    query.awaitTermination()
    assert query.exception() is None
    assert _stored(spark, out) == (tracked, events)


def test_options_that_need_the_previous_scan(spark, whole, tmp_path):
    cells, _, _ = whole
    out = str(tmp_path / "out")
    detection = replace(tb.DETECTION, postprocess_with_previous=True)
    tracking = TrackingParams(use_displacement_vectors=True)
    advance(spark, cells.where("scan < 3"), out, 0, tb.GRID, tb.VARIABLES, detection, tracking)
    clusters = spark.read.parquet(f"{out}/clusters")
    members = spark.read.parquet(f"{out}/members")
    assert clusters.select("scan").distinct().count() == 3
    assert clusters.count() == clusters.select("uuid").distinct().count()
    sizes = {r["cluster"]: r["count"] for r in members.groupBy("cluster").count().collect()}
    assert sizes == {r["cluster"]: r["size"] for r in clusters.collect()}


def test_one_detection_per_batch_changes_nothing(spark, whole, tmp_path, monkeypatch):
    """Options that feed scans into the next: scans of one batch are detected together, with the ids of scan by scan."""
    from skytrace.plans import incremental

    cells, _, _ = whole
    calls = []
    monkeypatch.setattr(incremental, "detect", lambda *a, **k: (calls.append(1), detect(*a, **k))[1])
    detection, tracking = replace(tb.DETECTION, postprocess_with_previous=True), TrackingParams(use_displacement_vectors=True)
    at_once, one_by_one = str(tmp_path / "a"), str(tmp_path / "b")
    advance(spark, cells.where("scan < 3"), at_once, 0, tb.GRID, tb.VARIABLES, detection, tracking)
    assert len(calls) == 1
    for scan in range(3):
        advance(spark, cells.where(F.col("scan") == scan), one_by_one, scan, tb.GRID, tb.VARIABLES, detection, tracking)
    assert _stored(spark, at_once) == _stored(spark, one_by_one)


def _labels(spark, cells, previous):
    """Merged clusters of ``cells`` {cluster: pids} against ``previous`` {cluster: pids}: {label: parts}."""
    from skytrace.operators import clustering

    long = lambda d, name: spark.createDataFrame([(0, p, c) for c, ps in d.items() for p in ps], f"pair int, pid bigint, {name} bigint")
    members = long(cells, "n").select(F.col("n").alias("cluster"), F.col("pid").alias("gid"))
    clusters = spark.createDataFrame([(c, len(ps), float(c)) for c, ps in cells.items()], "cluster bigint, size bigint, mode_v double")
    mapping = clustering.consolidate_with_previous(clustering.cell_cover(long(cells, "n"), long(previous, "m")), clusters, ["mode_v"])
    out = {}
    for r in clustering.consolidated_groups(mapping, members, ["mode_v"]).collect():
        out.setdefault((r["label"], round(r["mode_v"], 6)), set()).add(r["n"])
    return out


def test_a_cluster_held_by_two_previous_ones_joins_both(spark):
    # cluster 10 has a half of its cells in each previous cluster, which hold 20 and 30 besides
    cells = {10: [10, 11, 12, 13], 20: [20, 21], 30: [30, 31], 40: [40]}
    previous = {1: [10, 11, 20, 21], 2: [12, 13, 30, 31], 3: [40]}
    assert _labels(spark, cells, previous) == {(10, 15.0): {10, 20}, (11, 20.0): {10, 30}}
    # the same parts twice make one cluster; a part alone makes none
    assert _labels(spark, {10: [10, 11], 20: [20, 21]}, {1: [10, 20], 2: [11, 21]}) == {(10, 15.0): {10, 20}}
    assert _labels(spark, {10: [10, 11]}, {1: [10], 2: [11]}) == {}
    # a part of one cell can't name two clusters: they become one
    assert _labels(spark, {10: [10], 20: [20], 30: [30]}, {1: [10, 20], 2: [10, 30]}) == {(10, 15.0): {10, 20, 30}}


def _gappy(spark):
    """Five scans 300 s apart; the first, third and last have no cluster (their cells are below the threshold)."""
    rows = []
    for scan in range(5):
        for y in range(8):
            for x in range(8):
                value = 50 if scan in (1, 3) and 2 <= y <= 4 and 2 <= x <= 4 else 1
                rows.append((scan, 300 * scan, y, x, value, 10))
    return spark.createDataFrame(rows, "scan bigint, ts bigint, y int, x int, v_raw int, u_raw int")


@pytest.mark.parametrize("cuts", [[(0, 4)], [(0, 0), (1, 1), (2, 2), (3, 4)], [(0, 2), (3, 3), (4, 4)], [(0, 1), (2, 4)]])
def test_scans_without_clusters_end_tracks(spark, tmp_path, cuts):
    cells, out = _gappy(spark), str(tmp_path / "out")
    detection = replace(tb.DETECTION, lower={"v": 10.0})
    found = detect(cells, tb.GRID, tb.VARIABLES, detection)
    whole = track(found.clusters, found.members, cells.select("scan", "ts").distinct(), tb.GRID, tb.TRACKING)
    want = sorted((r["scan"], r["id"]) for r in whole.tracked.collect())
    assert want == [(1, 1), (3, 2)]
    for batch, (lo, hi) in enumerate(cuts):
        advance(spark, cells.where(F.col("scan").between(lo, hi)), out, batch, tb.GRID, tb.VARIABLES, detection, tb.TRACKING)
    # cells of an empty scan that was processed are late, too
    advance(spark, cells.where("scan = 4"), out, len(cuts), tb.GRID, tb.VARIABLES, detection, tb.TRACKING)
    stored = spark.read.parquet(f"{out}/clusters")
    assert sorted((r["scan"], r["id"]) for r in stored.collect()) == want
    assert sorted(r["scan"] for r in spark.read.parquet(f"{out}/scans").collect()) == [0, 1, 2, 3, 4]
