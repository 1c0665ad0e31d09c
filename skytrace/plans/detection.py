"""The detection plan: cells to clusters, for any number of scans at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.functions.kernels import KERNELS, Kernel
from skytrace.functions.weights import IR_108, WeightFunction, initiation_weight, weigh
from skytrace.operators import aggregates, clustering, featurespace, filters, meanshift
from skytrace.operators.featurespace import Variable
from skytrace.params import DetectionParams, Grid
from skytrace.session import attach, cut, keep, store


@dataclass
class Detection:
    """Stage tables of one detection run. ``members`` hold stored values, smoothed ones as ``mode_src_<var>``."""

    points: DataFrame
    weighted: DataFrame
    shifts: DataFrame
    members: DataFrame
    clusters: DataFrame


def feature_points(cells: DataFrame, grid: Grid, variables: list[Variable], params: DetectionParams) -> DataFrame:
    return featurespace.build(cells, grid, variables, params.lower, params.upper, params.replacement)


def detect(
    cells: DataFrame,
    grid: Grid,
    variables: list[Variable],
    params: DetectionParams,
    weight: WeightFunction | None = None,
    kernel: Kernel | None = None,
    blocked: DataFrame | None = None,
    comparison: DataFrame | None = None,
) -> Detection:
    """Run the whole plan. ``weight`` and ``kernel`` override the named ones; ``blocked`` lists off-limits cells (default:
    cells with an invalid variable).

    The weight ``oase-ci`` needs the satellite channels, radar and lightning among the variables. With ``ci_compare_previous`` each
    scan is compared with the one before, moved along its tracked protoclusters; else ``comparison`` may hold the cells of comparison scans under the
    scan number they are compared with, which are taken as they are.
    """
    names = [v.name for v in variables]
    limits = {v.name: v.limits for v in variables}
    ranges = params.bandwidth(grid, limits)
    spatial = tuple(ranges[: len(grid.dims)])
    size = params.kernel_size(grid)
    stored = feature_points(cells, grid, variables, params)
    points = stored
    columns = ["c_" + d for d in grid.dims] + names
    for variable, mode, fraction in params.replacement_filters:
        points = filters.replacement(points, grid, variable, mode, fraction, ranges, columns)
    if params.convection_variable:
        points = filters.convection(points, grid, params.convection_variable, ranges)
    smoothed = params.scale is not None
    if smoothed:
        points = keep(filters.scale_space(points, grid, names, params.scale, params.symmetric_smoothing))
        # weights use each scan's limits of the filtered values
        seen = store(featurespace.value_ranges(points, names, ["scan"]))
        points = attach(points, seen, ["scan"], "gid", part_of=seen)
        limits = {n: (F.col(n + "_min"), F.col(n + "_max")) for n in names}
    if weight is None and params.weight == "oase-ci":
        weight = _initiation(cells, comparison, grid, variables, params, spatial)
    weighted = weight(points) if weight else weigh(points, params.weight, grid, names, limits, spatial)
    weighted = weighted.drop(*[n + end for n in names for end in ("_min", "_max")])
    weighted = filters.weight_between(weighted, params.weight_lower, params.weight_upper)
    profile = kernel if kernel is not None else KERNELS[params.kernel]
    search_names, search_ranges = ([], spatial) if params.spatial_range_only else (names, ranges)
    shifts = keep(meanshift.shift_vectors(weighted, grid, search_names, search_ranges, profile, size, "w"))
    if params.replace_zero_shifts:
        shifts = keep(clustering.mean_neighbour_shift(shifts, grid, search_names))
    labels = clustering.components(shifts, grid)
    if params.add_strongest_neighbour:
        labels = cut(clustering.add_strongest_neighbour(labels, shifts, grid))
    if params.coalesce:
        labels = clustering.coalesce(labels, shifts, grid)
    if params.min_cluster_size > 1:
        labels = keep(clustering.large_labels(labels, shifts, params.min_cluster_size))
    members = clustering.finalise(labels, shifts)
    members = members.withColumns({"mode_src_" + n: F.col(n) for n in names})
    if smoothed:
        members = clustering.raw_values(members, stored, names)
    members = keep(members)
    if blocked is None:
        blocked = cells.where(featurespace.off_limits(variables)).select("scan", *grid.dims)
    return Detection(stored, weighted, shifts, members, describe(members, grid, names, blocked))


def _initiation(
    cells: DataFrame, comparison: DataFrame | None, grid: Grid, variables: list[Variable], params: DetectionParams,
    spatial: tuple[float, ...],
) -> WeightFunction:
    """Convective-initiation score from unpacked channels, NULL where invalid, with signals within the spatial bandwidth.

    The current channels are replaced by the coldest quarter around each cell."""
    from skytrace.plans import satellite

    def channels(df: DataFrame) -> DataFrame:
        values = {
            v.name: F.when(featurespace.is_valid(F.col(v.name + "_raw"), v), featurespace.unpack_value(F.col(v.name + "_raw"), v))
            for v in variables
        }
        return df.select("scan", *grid.dims, *[c.alias(n) for n, c in values.items()])

    limits = {v.name: v.limits for v in variables}
    if params.ci_compare_previous:
        scans = store(cells.select("scan", "ts").distinct())
        found = satellite.compare_with_previous(channels(cells), scans, grid, spatial, limits[IR_108], params)
        return lambda points: satellite.compared_weight(points, grid, found, spatial, params.ci_satellite_only, params.ci_original_limits)
    now = satellite.current(channels(cells), grid, spatial)
    before = None if comparison is None else channels(comparison)
    return lambda points: initiation_weight(points, grid, now, spatial, before, params.ci_satellite_only, params.ci_original_limits)


def describe(members: DataFrame, grid: Grid, names: list[str], blocked: DataFrame, first_uuid: int = 0) -> DataFrame:
    """The cluster table: size, centre, bounding box, mode, ranges, radius, margin flag, uuid and per-scan id."""
    summary = cut(aggregates.summarise(members, grid, names, ["mode_src_" + n for n in names]))
    radius = aggregates.radius(members, summary, grid).select("cluster", "radius_m")
    margin = clustering.margin_flags(members, blocked, grid).select("cluster", F.lit(True).alias("_m"))
    table = summary.join(radius, "cluster").join(margin, "cluster", "left")
    table = table.withColumn("has_margin", F.coalesce("_m", F.lit(False))).drop("_m")
    return keep(clustering.number_clusters(cut(table), first_uuid))
