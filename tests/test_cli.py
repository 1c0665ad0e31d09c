"""Configuration and command line."""

import json

import pytest
from pyspark.sql import functions as F

from skytrace import cli, params
from skytrace.sources import tables as tb

CONFIG = {
    "description": "test run",
    "data": {"variables": [{"name": "v", "lowerThreshold": 0, "upperThreshold": 28, "replacementValue": None}, {"name": "u"}], "dimensions": ["y", "x"]},
    "detection": {"usePrevious": False, "minClusterSize": 3},
    "tracking": {"histogramVariable": "v", "histogramWeight": 0, "positionWeight": 1, "sizeWeight": 0, "maxSpeed": None, "maxTime": None},
}
GRID = {
    "dimensions": ["y", "x"], "sizes": [25, 27], "units": ["km", "km"],
    "variables": [{"name": "v", "scale_factor": 0.5, "valid_max": 60.0, "fill_value": 255.0}, {"name": "u", "valid_max": 104.0}],
}


def test_config_keeps_zero_thresholds():
    dims, detection, tracking, _ = params.from_config(CONFIG)
    assert dims == ("y", "x")
    assert detection.lower == {"v": 0.0} and detection.upper == {"v": 28.0} and detection.replacement == {}
    assert detection.min_cluster_size == 3 and not detection.postprocess_with_previous
    assert tracking.size_weight == 0.0 and tracking.range_weight == 1.0 and tracking.max_velocity == 50.0


def test_free_option_strings_of_a_configuration():
    config = json.loads(json.dumps(CONFIG))
    config["detection"]["any-detect"] = "--verbosity 1 --weight-function inverse --wwf-lower-threshold 0.5 -k gauss -s 4 --ranges=2,2,10 -m 7 --lower-thresholds v=2 --replacement-filter v-lowest-25 --coalesce --vtk-dimensions x,y"
    config["tracking"]["any-track"] = "--verbosity 3 -t u --wr=0.5 --ws 0.25 --max-time 600 --discontinue-id-in-merge-and-split"
    dims, d, t, _ = params.from_config(config)
    assert (d.weight, d.weight_lower, d.kernel, d.scale, d.ranges, d.min_cluster_size) == ("inverse", 0.5, "gauss", 4.0, (2.0, 2.0, 10.0), 7)
    assert d.lower == {"v": 2.0} and d.upper == {"v": 28.0} and d.replacement_filters == (("v", "lowest", 0.25),) and d.coalesce and not d.spatial_range_only
    assert (t.tracking_variable, t.range_weight, t.size_weight, t.max_delta_t, t.continue_ids) == ("u", 0.5, 0.25, 600.0, False)
    assert dims == ("y", "x") and d.variables == ("v", "u")
    # options at the top of the file, dimensions and variables among them
    dims, d, t, _ = params.from_config({"x-detect": "--d z,y,x -v a,b --upper-thresholds a=75 --min-cluster-size=27", "x-track": "-t a --wt=0.0"})
    assert (dims, d.variables, d.upper, d.min_cluster_size, t.tracking_variable) == (("z", "y", "x"), ("a", "b"), {"a": 75.0}, 27, "a")
    for part, text in (("detection", "--kernel cubic"), ("detection", "--nonsense 1"), ("detection", "stray"), ("detection", "-m many"), ("tracking", "--wx 1")):
        broken = {**CONFIG, part: {**CONFIG[part], "p-detect" if part == "detection" else "p-track": text}}
        with pytest.raises(ValueError):
            params.from_config(broken)


def test_option_lists():
    assert params.parse_assignments("a=1, b=2.5") == {"a": 1.0, "b": 2.5}
    assert params.parse_replacement_filters("v-lowest-25,u-median") == (("v", "lowest", 0.25), ("u", "median", 1.0))
    with pytest.raises(ValueError):
        params.parse_replacement_filters("v-middle")


def test_key_paths():
    tree = params.path_set({}, "a.b.c", 0)
    assert params.path_get(tree, "a.b.c") == 0 and params.path_get(tree, "a.x.c", "none") == "none"


def test_defaults():
    a = cli.parser().parse_args(["detect", "--grid", "g"])
    d, t = cli.detection_params(a, ["v"]), cli.tracking_params(a)
    assert (d.kernel, d.weight, d.min_cluster_size, d.scale) == ("uniform", "default", 1, None)
    assert (t.range_weight, t.size_weight, t.correlation_weight) == (1.0, 1.0, 0.0)
    assert t.merge_split_threshold == pytest.approx(1 / 3) and t.continuation_threshold == 0.75
    assert (t.max_velocity, t.max_delta_t, t.max_size_deviation, t.continue_ids) == (50.0, 915.0, 3.0, True)


def test_run_and_statistics(spark, sf_dir, tmp_path):
    cells, out = str(tmp_path / "cells"), str(tmp_path / "out")
    tb.cells(spark, sf_dir).withColumns({"v_raw": F.col("v_raw").cast("double"), "u_raw": F.col("u_raw").cast("double")}).write.parquet(cells)
    (tmp_path / "config.json").write_text(json.dumps(CONFIG))
    (tmp_path / "grid.json").write_text(json.dumps(GRID))
    common = ["run", "-c", str(tmp_path / "config.json"), "-f", cells, "-o", out, "--grid", str(tmp_path / "grid.json"), "--ranges", "2,2,10,50"]
    cli.parser().parse_args(common).run(spark, cli.parser().parse_args([*common, "--start", "0", "--end", "4"]))
    first = spark.read.parquet(f"{out}/clustering/clusters")
    assert first.select("scan").distinct().count() == 5
    resumed = cli.parser().parse_args([*common, "--resume", "--skip-trackstats"])
    resumed.run(spark, resumed)
    clusters = spark.read.parquet(f"{out}/clustering/clusters")
    assert clusters.select("scan").distinct().count() == 10
    assert clusters.count() == clusters.select("uuid").distinct().count()
    lines = [r[0] for r in spark.read.text(f"{out}/clustering/statistics/length/histogram").collect()]
    assert len(lines) >= 22 and lines[0].startswith("5,")
    tracks = spark.read.json(f"{out}/clustering/statistics/dictionary/tracks")
    assert {"id", "length", "clusters", "min", "max"} <= set(tracks.columns)
    header = spark.read.csv(f"{out}/clustering/statistics/comparison/objects", sep=";", header=True)
    assert header.columns == ["timestep", "id", "centerx", "centery", "volume", "boxxmin", "boxxmax", "boxymin", "boxymax", "lwpmean", "lwpmin", "lwpmax"]


def test_files(spark, tmp_path):
    from skytrace.sources import files

    head = b"RX010740100000713BY 810134VS 3SW   2.12.0PR E+00INT   5GP   2x  3MS 67<boo>\x03"
    (tmp_path / "raa01-rx_10000-1307010740-dwd---bin").write_bytes(head + bytes([0, 65, 130, 249, 250, 145]))
    cells = {(r["y"], r["x"]): r["rx_raw"] for r in files.read_radar_composites(spark, str(tmp_path), threshold=20.0).collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (0, 2): 130, (1, 0): 250, (1, 1): 250, (1, 2): 145}
    ts = files.read_radar_composites(spark, str(tmp_path)).first()["ts"]
    assert ts == 1372664400
    (tmp_path / "raa01-ry_10000-1307010740-dwd---bin").write_bytes(head.replace(b"RX", b"RY") + bytes(12))
    (tmp_path / "raa01-short").write_bytes(head + bytes(3))
    (tmp_path / "raa01-none").write_bytes(b"text without a header")
    assert files.read_radar_composites(spark, str(tmp_path)).count() == 6
    assert {r["name"][6:11]: r["reason"] for r in files.radar_rejects(spark, str(tmp_path)).collect()} == {
        "ry_10": "product RY is not a one-byte composite", "short": "3 of 6 pixels", "none": "no header with a grid size"}
    for extra in ("raa01-ry_10000-1307010740-dwd---bin", "raa01-short", "raa01-none"):
        (tmp_path / extra).unlink()
    assert [r["name"] for r in files.list_directory(spark, str(tmp_path), "raa01*").collect()] == ["raa01-rx_10000-1307010740-dwd---bin"]


def test_command_line_tracks_over_empty_scans(spark, tmp_path):
    rows = [(scan, 300 * scan, y, x, 100.0 if scan != 1 and 2 <= y <= 4 and 2 <= x <= 4 else 1.0, 10.0) for scan in range(3) for y in range(8) for x in range(8)]
    spark.createDataFrame(rows, "scan bigint, ts bigint, y int, x int, v_raw double, u_raw double").write.parquet(str(tmp_path / "cells"))
    (tmp_path / "grid.json").write_text(json.dumps(GRID))
    grid, out = str(tmp_path / "grid.json"), str(tmp_path / "out")
    for argv in (["detect", "-f", str(tmp_path / "cells"), "-o", out, "--grid", grid, "--lower-thresholds", "v=10", "--ranges", "2,2,10,50"], ["track", "--input", out, "--output", out, "--grid", grid]):
        a = cli.parser().parse_args(argv)
        a.run(spark, a)
    assert sorted((r["scan"], r["id"]) for r in spark.read.parquet(f"{out}/clusters").collect()) == [(0, 1), (2, 2)]
    directions = cli.parser().parse_args(["trackstats", "-s", out, "--output", out, "--grid", grid, "-3"])
    with pytest.raises(SystemExit):
        directions.run(spark, directions)


def test_time_slice(spark):
    cells = spark.createDataFrame([(t // 10, t) for t in range(0, 100, 10)] * 2, "scan bigint, ts bigint")
    steps = lambda *a: sorted({r["scan"] for r in cli.time_slice(cells, *a).collect()})
    assert steps(-1) == list(range(10)) and steps(-1, 3) == [0, 1, 2, 3] and steps(4) == [4] and steps(2, 5) == [2, 3, 4, 5] and steps(12) == []


def test_unreadable_results_are_not_overwritten(spark, tmp_path):
    (tmp_path / "out" / "scans").mkdir(parents=True)
    (tmp_path / "out" / "scans" / "part-0.parquet").write_text("broken")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        cli._next_batch(spark, str(tmp_path / "out"))
    assert cli._next_batch(spark, str(tmp_path / "none")) == 0


def test_foreign_records_and_rejects(spark, tmp_path):
    from skytrace.sources import files

    good = "13 07 01 07 40 5 1 1.5 2.5 3 4 5.5 6 0 1.0 1 1 2 2"
    (tmp_path / "records.txt").write_text(good + "\n" + good.replace("13 07 01", "13 02 30") + "\n1 2 3\n\n")
    rows = files.read_konrad(spark, str(tmp_path)).collect()
    assert sorted((r["month"], r["ts"]) for r in rows) == [(2, None), (7, 1372664400)]
    assert sorted(r["fields"] for r in files.konrad_rejects(spark.read.text(str(tmp_path))).collect()) == [0, 3]
