"""Command line: ``detect``, ``track``, ``trackstats`` and ``run`` over parquet cell and cluster tables.

The grid comes from a JSON file: {"dimensions": [...], "sizes": [...], "resolution": [...], "origin": [...], "units": [...],
"variables": [{"name", "scale_factor", "add_offset", "valid_min", "valid_max", "fill_value"}, ...]}; direction statistics also need
"plane_origin": [x, y], the place of the grid's zero on the stereographic plane in km.
"""

from __future__ import annotations

import argparse
import json
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrace import __version__
from skytrace.operators import aggregates, trackstats
from skytrace.operators.featurespace import Variable
from skytrace.operators.ordering import number_rows
from skytrace.params import (
    CLUSTER_CLASSES, DIRECTION_CLASSES, LENGTH_CLASSES, SIZE_CLASSES, SPEED_CLASSES, DetectionParams, Grid, StatsParams,
    TrackingParams, from_config, parse_assignments, parse_replacement_filters,
)
from skytrace.plans.detection import detect
from skytrace.plans.incremental import advance, stored
from skytrace.plans.tracking import graph, track
from skytrace.session import attach
from skytrace.sources import files, sinks


def load_grid(path: str) -> tuple[Grid, list[Variable]]:
    with open(path, encoding="utf-8") as fh:
        spec = json.load(fh)
    n = len(spec["dimensions"])
    grid = Grid(
        tuple(spec["dimensions"]), tuple(spec["sizes"]), tuple(map(float, spec.get("resolution", [1.0] * n))),
        tuple(map(float, spec.get("origin", [0.0] * n))), tuple(spec.get("units", ["m"] * n)),
    )
    return grid, [Variable(**v) for v in spec["variables"]]


def load_plane_origin(path: str) -> tuple[float, float] | None:
    with open(path, encoding="utf-8") as fh:
        origin = json.load(fh).get("plane_origin")
    return None if origin is None else (float(origin[0]), float(origin[1]))


def _numbers(text: str | None) -> tuple[float, ...] | None:
    return tuple(float(v) for v in text.split(",")) if text else None


def add_detection_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--file", "-f", help="parquet table of cells")
    p.add_argument("--output", "-o", help="folder for the results")
    p.add_argument("--grid", required=True, help="JSON description of grid and variables")
    p.add_argument("--variables", "-v", help="comma-separated subset of the variables")
    p.add_argument("--time-index", "-t", type=int, default=-1, help="only this step (in time order); -1 for all")
    p.add_argument("--lower-thresholds", help="var1=val,var2=val,...")
    p.add_argument("--upper-thresholds", help="var1=val,var2=val,...")
    p.add_argument("--replacement-values", help="var1=val,var2=val,...")
    p.add_argument("--kernel-name", "-k", default="uniform", choices=["uniform", "gauss", "epanechnikov", "none"])
    p.add_argument("--weight-function-name", "-w", default="default", help="default, inverse, pow10 or oase")
    p.add_argument("--wwf-lower-threshold", type=float, default=0.0)
    p.add_argument("--wwf-upper-threshold", type=float)
    p.add_argument("--replacement-filter", help="name-lowest-25,name-median,...")
    p.add_argument("--convection-filter-variable")
    p.add_argument("--coalesce-with-strongest-neighbour", action="store_true")
    p.add_argument("--postprocess-with-previous-output", action="store_true")
    p.add_argument("--scale", "-s", type=float)
    p.add_argument("--ranges", "-r", help="bandwidths: dimensions, then variables")
    p.add_argument("--min-cluster-size", "-m", type=int, default=1)
    p.add_argument("--spatial-range-only", action="store_true")
    p.add_argument("--ci-comparison-file", help="cells of the comparison scans, numbered like the scans they are compared with")
    p.add_argument("--ci-compare-previous", action="store_true", help="compare each scan with the one before, moved along its tracked protoclusters")
    p.add_argument("--ci-protocluster-scale", type=float, default=DetectionParams.ci_protocluster_scale)
    p.add_argument("--ci-protocluster-min-size", type=int, default=DetectionParams.ci_protocluster_min_size)
    p.add_argument("--ci-satellite-only", action="store_true")
    p.add_argument("--ci-use-walker-mecikalski", action="store_true", help="original limits of the score")
    p.add_argument("--inline-tracking", action="store_true", help="track right after detection")


def add_tracking_options(p: argparse.ArgumentParser) -> None:
    d = TrackingParams()
    p.add_argument("--tracking-variable")
    p.add_argument("--wr", type=float, default=d.range_weight)
    p.add_argument("--ws", type=float, default=d.size_weight)
    p.add_argument("--wt", type=float, default=d.correlation_weight)
    p.add_argument("--use-displacement-vectors", action="store_true")
    p.add_argument("--merge-split-threshold", type=float, default=d.merge_split_threshold)
    p.add_argument("--merge-split-continuation-threshold", type=float, default=d.continuation_threshold)
    p.add_argument("--discontinue-id-in-merge-and-split", action="store_true")
    p.add_argument("--max-speed", type=float, default=d.max_velocity)
    p.add_argument("--max-time", type=float, default=d.max_delta_t)
    p.add_argument("--max-size-deviation", type=float, default=d.max_size_deviation)


def detection_params(a: argparse.Namespace, names: list[str]) -> DetectionParams:
    return DetectionParams(
        variables=tuple(names), lower=parse_assignments(a.lower_thresholds), upper=parse_assignments(a.upper_thresholds),
        replacement=parse_assignments(a.replacement_values), kernel=a.kernel_name, weight=a.weight_function_name,
        weight_lower=a.wwf_lower_threshold, weight_upper=a.wwf_upper_threshold, scale=a.scale, ranges=_numbers(a.ranges),
        min_cluster_size=a.min_cluster_size, time_index=a.time_index,
        replacement_filters=parse_replacement_filters(a.replacement_filter), convection_variable=a.convection_filter_variable,
        coalesce=a.coalesce_with_strongest_neighbour, postprocess_with_previous=a.postprocess_with_previous_output,
        spatial_range_only=a.spatial_range_only, ci_satellite_only=a.ci_satellite_only, ci_original_limits=a.ci_use_walker_mecikalski,
        ci_compare_previous=a.ci_compare_previous, ci_protocluster_scale=a.ci_protocluster_scale, ci_protocluster_min_size=a.ci_protocluster_min_size,
    )


def tracking_params(a: argparse.Namespace) -> TrackingParams:
    return TrackingParams(
        a.wr, a.ws, a.wt, not a.discontinue_id_in_merge_and_split, a.merge_split_threshold, a.merge_split_continuation_threshold,
        a.max_speed, a.max_time, True, a.max_size_deviation, a.tracking_variable, a.use_displacement_vectors,
    )


def time_slice(cells: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Scans by step in time order; the end is included. Without a start they begin at the first, without an end only ``start`` is taken."""
    if start < 0 and end is None:
        return cells
    first, last = max(start, 0), start if end is None else end
    steps = number_rows(cells.select("ts").distinct(), "ts", "step").where((F.col("step") > first) & (F.col("step") <= last + 1))
    span = steps.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    return cells.limit(0) if span["first"] is None else cells.where(F.col("ts").between(span["first"], span["last"]))


def cmd_detect(spark: SparkSession, a: argparse.Namespace) -> None:
    grid, variables = load_grid(a.grid)
    if a.variables:
        variables = [v for v in variables if v.name in a.variables.split(",")]
    params = detection_params(a, [v.name for v in variables])
    cells = time_slice(spark.read.parquet(a.file), a.time_index)
    if a.inline_tracking or a.postprocess_with_previous_output:
        advance(spark, cells, a.output, _next_batch(spark, a.output), grid, variables, params, tracking_params(a))
        return
    comparison = spark.read.parquet(a.ci_comparison_file) if a.ci_comparison_file else None
    found = detect(cells, grid, variables, params, comparison=comparison)
    found.clusters.write.mode("overwrite").parquet(f"{a.output}/detected/clusters")
    found.members.write.mode("overwrite").parquet(f"{a.output}/detected/members")
    cells.select("scan", "ts").distinct().write.mode("overwrite").parquet(f"{a.output}/detected/scans")


def _next_batch(spark: SparkSession, output: str) -> int:
    """Number of the batch after the stored ones."""
    known = stored(spark, f"{output}/scans")
    last = None if known is None else known.agg(F.max("batch")).first()[0]
    return 0 if last is None else last + 1


def cmd_track(spark: SparkSession, a: argparse.Namespace) -> None:
    grid, variables = load_grid(a.grid)
    # scans without clusters separate tracks, so they come from their own table
    clusters, members, scans = (spark.read.parquet(f"{a.input}/detected/{t}") for t in ("clusters", "members", "scans"))
    result = track(clusters, members, scans, grid, tracking_params(a), {v.name: v.limits for v in variables})
    sinks.write_clusters(a.output, result.tracked, members, result.events)
    # the cluster table under its plain name too, for readers that know no versions
    result.tracked.write.mode("overwrite").parquet(f"{a.output}/clusters")


def statistics(
    spark: SparkSession, path: str, output: str, grid: Grid, names: list[str], params: StatsParams, wanted: set[str], dictionary: bool, plot: bool,
    plane_origin: tuple[float, float] | None = None,
) -> None:
    """Distributions, histograms and the track dictionary of stored results. Directions need the grid's place on the stereographic plane."""
    if "direction" in wanted and plane_origin is None:
        raise SystemExit("direction statistics need plane_origin in the grid file")
    clusters, members, events = files.read_clusters(spark, path)
    lengths = trackstats.track_lengths(clusters)
    used = trackstats.without_degenerates(clusters, lengths) if params.exclude_degenerates else clusters
    members = attach(members, clusters.select("cluster", "id"), ["cluster"], "gid")
    sources = {
        "length": lambda: (trackstats.track_lengths(used), "length", params.length_classes),
        "speed": lambda: (trackstats.speeds(used, grid), "speed", params.speed_classes),
        "direction": lambda: (trackstats.directions(used, grid.dims[-1], grid.dims[-2], plane_origin), "direction", params.direction_classes),
        "cluster": lambda: (used, "size", params.cluster_classes),
        "size": lambda: (trackstats.cumulated_sizes(members), "cells", params.size_classes),
    }
    trackstats.degenerates(lengths).write.mode("overwrite").json(f"{output}/summary")
    for kind in wanted:
        table, value, classes = sources[kind]()
        dist = trackstats.distribution(table, value)
        dist.write.mode("overwrite").csv(f"{output}/{kind}/distribution", header=True)
        trackstats.weighted_average(dist, value, kind != "size").write.mode("overwrite").json(f"{output}/{kind}/average")
        sinks.write_lines(f"{output}/{kind}/histogram", sinks.histogram_lines(trackstats.class_histogram(table, value, classes), classes[-1]))
        if plot:
            sinks.value_lines(dist, value).write.mode("overwrite").text(f"{output}/{kind}/plot")
    if dictionary:
        medians = aggregates.value_medians(members, names).select("cluster", *[F.col(n).alias("median_" + n) for n in names])
        table = clusters.join(medians, "cluster").withColumn("source", F.col("scan").cast("string"))
        nodes = trackstats.nodes(clusters)
        of = lambda kind: events.where(F.col("kind") == kind).select("step", "id", "related")
        links = trackstats.links(nodes, of("tracked").select("step", "id"), of("merge"), of("split"))
        sinks.write_dictionary(f"{output}/dictionary", trackstats.dictionary_clusters(table, grid, names), nodes, links, list(grid.dims), names)
        sinks.write_tic(f"{output}/comparison", sinks.tic_objects(table, names[0], grid.dims[-2], grid.dims[-1]), sinks.tic_tracks(links, nodes))


def cmd_trackstats(spark: SparkSession, a: argparse.Namespace) -> None:
    grid, variables = load_grid(a.grid)
    params = StatsParams(
        a.exclude_degenerates, a.length_histogram_classes, a.size_histogram_classes, a.cluster_histogram_classes,
        a.speed_histogram_classes, a.direction_histogram_classes,
    )
    flags = {
        "length": a.create_length_statistics, "speed": a.create_speed_statistics, "direction": a.create_direction_statistics,
        "cluster": a.create_cluster_statistics, "size": a.create_cumulated_size_statistics,
    }
    wanted = {k for k, on in flags.items() if on}
    statistics(spark, a.sourcepath, a.output, grid, [v.name for v in variables], params, wanted, a.write_track_dictionary, a.write_gnuplot_files, load_plane_origin(a.grid))


def cmd_run(spark: SparkSession, a: argparse.Namespace) -> None:
    """Whole runs from a JSON configuration, once per scale."""
    dims, detection, tracking, stats = from_config(a.config)
    grid, variables = load_grid(a.grid)
    variables = [v for v in variables if v.name in detection.variables]
    if dims and tuple(dims) != grid.dims:
        raise ValueError(f"configured dimensions {dims} differ from the grid's {grid.dims}")
    if a.ranges:
        detection = replace(detection, ranges=_numbers(a.ranges))
    for scale in a.scales.split(",") if a.scales else [None]:
        started = time.time()
        target = f"{a.output}/scale{scale}" if scale else f"{a.output}/clustering"
        params = replace(detection, scale=float(scale)) if scale else detection
        batch = _next_batch(spark, target)
        if batch and not a.resume:
            raise SystemExit(f"{target} holds results of an earlier run: continue them with --resume or choose another output")
        advance(spark, time_slice(spark.read.parquet(a.file), a.start, a.end), target, batch, grid, variables, params, tracking)
        if not a.skip_trackstats:
            statistics(spark, target, f"{target}/statistics", grid, [v.name for v in variables], stats, {"length", "speed", "cluster", "size"}, True, False)
        if a.time_operations:
            print(f"{target}: {time.time() - started:.2f} seconds")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="skytrace")
    top.add_argument("--version", action="version", version=__version__)
    sub = top.add_subparsers(required=True)
    p = sub.add_parser("detect", help="find clusters in every scan")
    add_detection_options(p)
    add_tracking_options(p)
    p.set_defaults(run=cmd_detect)
    p = sub.add_parser("track", help="track detected clusters")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--grid", required=True)
    add_tracking_options(p)
    p.set_defaults(run=cmd_track)
    p = sub.add_parser("trackstats", help="statistics over tracks")
    p.add_argument("--sourcepath", "-s", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--grid", required=True)
    p.add_argument("--exclude-degenerates", "-n", type=lambda t: t.lower() in ("1", "true", "yes"), default=True)
    for flag, name in (("-1", "length"), ("-2", "speed"), ("-3", "direction"), ("-4", "cluster"), ("-6", "cumulated-size")):
        p.add_argument(flag, f"--create-{name}-statistics", action="store_true")
    for name, classes in (("length", LENGTH_CLASSES), ("size", SIZE_CLASSES), ("cluster", CLUSTER_CLASSES), ("speed", SPEED_CLASSES), ("direction", DIRECTION_CLASSES)):
        p.add_argument(f"--{name}-histogram-classes", type=_numbers, default=tuple(map(float, classes)))
    p.add_argument("--write-track-dictionary", "-t", action="store_true")
    p.add_argument("--write-gnuplot-files", "-g", action="store_true")
    p.set_defaults(run=cmd_trackstats)
    p = sub.add_parser("run", help="detection, tracking and statistics from a JSON configuration")
    p.add_argument("-c", "--config", required=True)
    p.add_argument("-f", "--file", required=True)
    p.add_argument("-o", "--output", default=".")
    p.add_argument("--grid", required=True)
    p.add_argument("--scales", "-s")
    p.add_argument("--ranges", "-r")
    p.add_argument("--start", type=int, default=-1)
    p.add_argument("--end", type=int)
    p.add_argument("--resume", action="store_true")
    p.add_argument("--skip-trackstats", action="store_true")
    p.add_argument("--time-operations", action="store_true")
    p.set_defaults(run=cmd_run)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("skytrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    a.run(spark, a)


if __name__ == "__main__":
    main()
