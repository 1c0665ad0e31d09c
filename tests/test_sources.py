"""Radar composites, published versions, polylines and directory listings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytrace.sources import files, polylines, publish, radar, sinks

TS = 1_372_664_400


def test_two_byte_flags():
    raw = np.array([0, 5, 0x4000 | 7, 0x2000 | 2500, 0x8000 | 9, 0x1000 | 4095])
    c = radar.decode(radar.encode("RY", TS, 2, 3, raw, -2))
    assert (c.product, c.ts, c.columns) == ("RY", TS, 3) and c.raw.tolist() == raw.tolist()
    assert np.array_equal(np.round(c.value, 9), [0, 0.05, -0.07, np.nan, np.nan, 40.95], equal_nan=True)
    assert c.missing.tolist() == [False] * 3 + [True, False, False] and c.clutter.tolist() == [False] * 4 + [True, False]
    assert c.secondary.tolist() == [False] * 5 + [True]


def test_one_byte_values():
    c = radar.decode(radar.encode("EX", TS, 1, 4, np.array([0, 65, 249, 250])))
    assert np.array_equal(c.value, [-32.5, 0.0, np.nan, np.nan], equal_nan=True) and c.clutter.tolist() == [False, False, True, False]


def test_files_with_rejects(spark, tmp_path):
    good = radar.encode("RW", TS, 2, 2, np.array([1, 2, 3, 4]), -1)
    for name, content in {
        "a": good, "b": radar.encode("RX", TS, 2, 2, np.array([10, 20, 30, 250])), "short": good[:-3], "other": b"XX" + good[2:], "time": good.replace(good[2:8], b"999999"),
        "precise": good.replace(b"PR E", b"PR X"), "none": b"\x03", "text": "ünter".encode(),
    }.items():
        (tmp_path / name).write_bytes(content)
    found = radar.composite_files(spark, str(tmp_path))
    rows = {(r["name"], r["y"], r["x"]): r["value"] for r in radar.pixels(found, threshold=0.25).collect()}
    want = {("a", 0, 0): 0.0, ("a", 0, 1): 0.0, ("a", 1, 0): 0.3, ("a", 1, 1): 0.4, ("b", 0, 0): -32.5, ("b", 0, 1): -32.5, ("b", 1, 0): -32.5, ("b", 1, 1): None}
    assert {k: v if v is None else round(v, 9) for k, v in rows.items()} == want
    assert {r["name"]: r["reason"] for r in radar.rejects(found).collect()} == {
        "short": "2 of 4 pixels", "other": "product XX is not known", "time": "no time in the header", "precise": "no precision in the header",
        "none": "no header with a grid size", "text": "no header with a grid size"}
    empty = found.where("name = 'nothing'")
    assert radar.pixels(empty).count() == radar.rejects(empty).count() == 0


def test_versions_appear_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "out")
    one = spark.range(3).selectExpr("id AS scan", "id AS cluster")
    assert publish.latest(spark, path) is None and publish.read(spark, path, "clusters") is None
    sinks.write_clusters(path, one, one, one)
    assert [d.count() for d in files.read_clusters(spark, path)] == [3, 3, 3]
    # the writer fails in its second table: readers keep the version before
    broken = spark.range(9).select("id", F.when(F.col("id") > 5, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("cluster")).withColumnRenamed("id", "scan")
    with pytest.raises(Exception, match="lost"):
        sinks.write_clusters(path, spark.range(9).selectExpr("id AS scan", "id AS cluster"), broken, one)
    assert [d.count() for d in files.read_clusters(spark, path)] == [3, 3, 3]
    # a version may be made from the one before, which stays readable while it is replaced
    before = files.read_clusters(spark, path)[0]
    sinks.write_clusters(path, before.unionByName(before).select("scan", "cluster"), one, one)
    assert [d.count() for d in files.read_clusters(spark, path)] == [6, 3, 3] and before.count() == 3
    assert publish.latest(spark, path)[0] == 2


def walk(vertices, sizes):
    """Fine sampling of every segment; the parts by the vertices outside."""
    inside = lambda x, y: 0 <= x <= sizes[0] - 1 and 0 <= y <= sizes[1] - 1
    out, part, was = [], -1, False
    for (x0, y0), (x1, y1) in zip(vertices, vertices[1:]):
        for t in np.linspace(0, 1, 4001):
            x, y = x0 + t * (x1 - x0), y0 + t * (y1 - y0)
            if inside(x, y):
                part += not was
                out.append((part, x, y))
            was = inside(x, y)
    return out


def test_polylines_leave_and_come_back(spark):
    rng = np.random.default_rng(1)
    lines = {i: (rng.random((30, 2)) * 30 - 8).tolist() for i in range(6)}
    rows = [(i, s, float(x), float(y)) for i, v in lines.items() for s, (x, y) in enumerate(v)]
    rows += [(90, 0, 3.0, 3.0)] + [(91, s, x, 50.0) for s, x in enumerate((0.0, 5.0, 9.0))] + [(92, 0, -5.0, 0.0), (92, 1, 20.0, 0.0)]
    df = spark.createDataFrame(rows, "line long, seq long, x double, y double")
    got = polylines.polyline_cells(df, (14, 12)).collect()
    assert {r["line"] for r in got} == {*lines, 92}
    assert all(0 <= r["x"] < 14 and 0 <= r["y"] < 12 for r in got)
    pieces = polylines.parts(polylines.clipped(polylines.segments(df), (0.0, 13.0, 0.0, 11.0))).collect()
    for i, v in lines.items():
        want = walk(v, (14, 12))
        mine = sorted((r for r in pieces if r["line"] == i), key=lambda r: r["seq"])
        assert max(r["part"] for r in mine) == max(p for p, _, _ in want)
        length = sum(np.hypot(r["x1"] - r["x0"], r["y1"] - r["y0"]) for r in mine)
        sampled = sum(np.hypot(b[1] - a[1], b[2] - a[2]) for a, b in zip(want, want[1:]) if a[0] == b[0])
        assert length == pytest.approx(sampled, rel=0.01)


def test_parts_are_numbered_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(polylines, "BLOCK", 4)
    rows = [(0, s, float(s % 6) * 4 - 6, 2.0) for s in range(60)]
    df = spark.createDataFrame(rows, "line long, seq long, x double, y double")
    small = sorted((r["seq"], r["part"]) for r in polylines.parts(polylines.clipped(polylines.segments(df), (0.0, 9.0, 0.0, 9.0))).collect())
    monkeypatch.setattr(polylines, "BLOCK", 1024)
    assert small == sorted((r["seq"], r["part"]) for r in polylines.parts(polylines.clipped(polylines.segments(df), (0.0, 9.0, 0.0, 9.0))).collect())
    assert len({p for _, p in small}) > 10


def test_listing(spark, tmp_path):
    spark.createDataFrame([("b", "x"), ("a", "y"), ("b", "z")], "name string, value string").write.partitionBy("name").text(str(tmp_path / "l"))
    steps = files.directory_steps(files.list_folders(spark, str(tmp_path / "l"), "name")).collect()
    assert sorted((r["step"], r["name"]) for r in steps) == [(0, "a"), (1, "b")]
