"""Convective initiation compared with the scan before: protoclusters, their tracks, forecast of the comparison scan, overlap area.

The chain is a plan inside a plan: before cells can be weighed, clusters of the window channel are detected and tracked over all scans at
once, and the scan before is moved along the tracks. Every step works on all scans; no step loops over them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.functions.satellite import CHANNELS, C1, C2, KELVIN
from skytrace.functions.weights import IR_108, IR_134, WV_062, initiation_weight
from skytrace.operators import filters
from skytrace.operators.featurespace import Variable
from skytrace.params import DetectionParams, Grid, TrackingParams
from skytrace.plans.detection import Detection, detect
from skytrace.plans.tracking import Tracks, track
from skytrace.session import attach, keep

SCORED = [IR_108, WV_062, IR_134]
# Scans may be a second or so off their 15 minutes.
MAX_DELTA_T = 930.0


def freezing_radiance(channel: str = IR_108) -> float:
    """Radiance of 0 degrees Celsius: clouds above the freezing level radiate less."""
    import math

    alpha, beta, nu = CHANNELS[channel]
    return nu ** 3 * C1 / (math.exp(C2 * nu / (KELVIN * alpha + beta)) - 1.0)


def protoclusters(cells: DataFrame, grid: Grid, limits: tuple[float, float], scale: float = 25.0, min_size: int = 10) -> Detection:
    """Detection on the infrared window channel alone, colder than freezing. ``cells`` hold it as ``<channel>_raw``."""
    channel = Variable(IR_108, valid_min=limits[0], valid_max=limits[1])
    params = DetectionParams(
        variables=(IR_108,), upper={IR_108: freezing_radiance()}, scale=scale, min_cluster_size=min_size, weight="inverse",
        kernel="uniform",
    )
    blocked = cells.where(F.col(IR_108 + "_raw").isNull()).select("scan", *grid.dims)
    return detect(cells, grid, [channel], params, blocked=blocked)


def shift_comparison(members: DataFrame, matches: DataFrame, tracked: DataFrame, grid: Grid, names: list[str]) -> DataFrame:
    """Move the previous scan's values inside each matched cluster by the cluster's displacement; later valid cells win."""
    vectors = matches.join(tracked.select(F.col("cluster").alias("n"), *["d_" + d for d in grid.dims]), "n").select(
        F.col("m").alias("cluster"), F.col("pair"), *["d_" + d for d in grid.dims])
    moved = attach(members.select("cluster", "gid", F.col("pid").alias("_source"), *["c_" + d for d in grid.dims], *names), vectors, ["cluster"], "gid")
    inside = F.lit(True)
    for d, o, r, n in zip(grid.dims, grid.origin, grid.resolution, grid.sizes):
        moved = moved.withColumn(d, F.round((F.col("c_" + d) + F.col("d_" + d) - F.lit(o)) / F.lit(r)).cast("int"))
        inside = inside & F.col(d).between(0, n - 1)
    landed = moved.where(inside)
    return landed.groupBy(F.col("pair").alias("scan"), *grid.dims).agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_source"))).alias(n) for n in names])


def overlap_area(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cells covered by a cluster in a scan and in the one before."""
    linked = pairs.where("linked").select("scan", "prev_scan")
    now = attach(members.select("scan", "pid"), linked.select("scan"), ["scan"], "pid")
    before = attach(members.select(F.col("scan").alias("prev_scan"), "pid"), linked, ["prev_scan"], "pid").select("scan", "pid")
    return now.join(before, ["scan", "pid"], "left_semi")


@dataclass
class Comparison:
    """What the score of scans with a predecessor needs. ``now`` and ``before`` hold channels per (scan, cell), ``before`` those of the
    scan before, moved to where they are expected; ``overlap`` lists (scan, pid), ``linked`` the scans that have a predecessor."""

    protoclusters: Detection
    tracks: Tracks
    now: DataFrame
    before: DataFrame
    overlap: DataFrame
    linked: DataFrame


def _coldest(channels: DataFrame, grid: Grid, spatial: tuple[float, ...]) -> DataFrame:
    """Each valid value of a scored channel by the mean of the coldest quarter around it."""
    reach = {d: round(h / r) for d, h, r in zip(grid.dims, spatial, grid.resolution)}
    on = ["scan", *grid.dims]
    cold = filters.coldest_shares(channels, grid, SCORED, reach).select(*on, *[F.col(c).alias("_" + c) for c in SCORED])
    return channels.join(cold, on).withColumns({c: F.when(F.col(c).isNotNull(), F.col("_" + c)) for c in SCORED}).drop(*["_" + c for c in SCORED])


def current(channels: DataFrame, grid: Grid, spatial: tuple[float, ...]) -> DataFrame:
    """The scans' own channels as the score takes them."""
    return keep(_coldest(channels, grid, spatial))


def compare_with_previous(
    channels: DataFrame, scans: DataFrame, grid: Grid, spatial: tuple[float, ...], limits: tuple[float, float], params: DetectionParams
) -> Comparison:
    """Protoclusters of ``channels``, tracked from scan to scan; the scan before moved with them.

    ``scans`` are (scan, ts). A cell onto which no cluster moves has no value before; neither has one whose moved
    values are invalid.
    """
    raw = channels.withColumn(IR_108 + "_raw", F.col(IR_108))
    found = protoclusters(raw, grid, limits, params.ci_protocluster_scale, params.ci_protocluster_min_size)
    tracks = track(found.clusters, found.members, scans, grid, TrackingParams(max_delta_t=MAX_DELTA_T, tracking_variable=IR_108))
    on = ["scan", *grid.dims]
    values = channels.select(*on, *SCORED)
    inside = found.members.select(*on, "cluster", "gid", "pid", *["c_" + d for d in grid.dims]).join(values, on)
    moved = keep(shift_comparison(inside, tracks.matches, tracks.tracked, grid, SCORED))
    linked = keep(tracks.pairs.where("linked").select("scan"))
    overlap = keep(overlap_area(found.members, tracks.pairs).select("scan", "pid"))
    return Comparison(found, tracks, current(channels, grid, spatial), keep(_coldest(moved, grid, spatial)), overlap, linked)


def compared_weight(
    points: DataFrame, grid: Grid, c: Comparison, spatial: tuple[float, ...], satellite_only: bool = False, original_limits: bool = False
) -> DataFrame:
    """The score with trends since the scan before, zero outside the overlap of its clusters with the current ones; a
    scan without a predecessor has neither trends nor overlap and is scored by its own channels."""
    marked = attach(points, c.linked.withColumn("_linked", F.lit(True)), ["scan"], "gid", "left")
    follow, first = (marked.where(cond).drop("_linked") for cond in ("_linked", "_linked IS NULL"))
    trend = initiation_weight(follow, grid, c.now, spatial, c.before, satellite_only, original_limits)
    inside = c.overlap.withColumn("_inside", F.lit(True))
    trend = trend.join(inside, ["scan", "pid"], "left").withColumn("w", F.when(F.col("_inside"), F.col("w")).otherwise(F.lit(0.0)))
    alone = initiation_weight(first, grid, c.now, spatial, None, satellite_only, original_limits)
    return trend.select(*alone.columns).unionByName(alone)
