"""From mean-shift vectors to clusters: edges, components, finalisation, flags, numbering and post-processing.

``members`` has one row per point of a cluster; ``cluster`` is the component label (a global cell id), so
cluster order within and across scans is the order of this label.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytrace.operators.components import connected_components
from skytrace.operators.neighbours import moore_pairs
from skytrace.operators.ordering import number_rows
from skytrace.params import Grid
from skytrace.session import attach, cut

TILE_CELLS = 16_384


def _fits_one_tile(grid: Grid) -> bool:
    side = int(TILE_CELLS ** (1.0 / len(grid.dims)))
    return all(n <= side for n in grid.sizes)


def _tile(grid: Grid, columns: dict[str, F.Column]) -> F.Column:
    """Number of the spatial tile of a grid point, unique across scans. A tile holds at most ``TILE_CELLS`` cells;
    where a whole scan is smaller than that, neighbouring scans share a tile to keep the groups worthwhile."""
    side = int(TILE_CELLS ** (1.0 / len(grid.dims)))
    per_dim = [-(-n // side) for n in grid.sizes]
    bundle = max(1, TILE_CELLS // math.prod(min(n, side) for n in grid.sizes))
    tile = F.col("scan")
    for d, n in zip(grid.dims, per_dim):
        tile = tile * F.lit(n) + F.floor(columns[d] / F.lit(side))
    return F.floor(tile / F.lit(bundle)).cast("bigint")


def zero_shift_edges(shifts: DataFrame, grid: Grid) -> DataFrame:
    """Edges between adjacent points whose spatial shift is zero, smaller id first."""
    still = shifts.where("zero_shift").select("scan", "gid", *grid.dims)
    pairs = moore_pairs(still, still, grid.dims).where("gid < n_gid")
    return pairs.select(
        "scan",
        F.col("gid").alias("src"),
        F.col("n_gid").alias("dst"),
        _tile(grid, {d: F.col(d) for d in grid.dims}).alias("src_tile"),
        _tile(grid, {d: F.col("n_" + d) for d in grid.dims}).alias("dst_tile"),
    )


def shift_edges(shifts: DataFrame, grid: Grid) -> DataFrame:
    """Edge from every moving original point to the point its gridded shift leads to, if there is one."""
    target = {d: F.col(d) + F.col("g_" + d) for d in grid.dims}
    inside = F.lit(True)
    for d, n in zip(grid.dims, grid.sizes):
        inside = inside & target[d].between(0, n - 1)
    moving = shifts.where(~F.col("zero_shift") & F.col("is_original") & inside)
    pid = F.lit(0).cast("bigint")
    for d, s in zip(grid.dims, grid.strides):
        pid = pid + target[d] * F.lit(s)
    ends = moving.select(
        "scan",
        F.col("gid").alias("src"),
        (F.col("scan") * F.lit(grid.cells) + pid).cast("bigint").alias("dst"),
        _tile(grid, {d: F.col(d) for d in grid.dims}).alias("src_tile"),
        _tile(grid, target).alias("dst_tile"),
    )
    return ends.join(shifts.select(F.col("gid").alias("dst")), "dst", "left_semi").select(
        "scan", "src", "dst", "src_tile", "dst_tile"
    )


def boundary_flags(shifts: DataFrame, grid: Grid) -> DataFrame:
    """A point that shifts onto another and is nobody's target lies on a boundary."""
    edges = shift_edges(shifts, grid)
    sources = edges.select("scan", F.col("src").alias("gid"))
    targets = edges.select(F.col("dst").alias("gid"))
    return sources.join(targets, "gid", "left_anti").select("scan", "gid")


def components(shifts: DataFrame, grid: Grid) -> DataFrame:
    """(gid, cluster) for every point with at least one edge; isolated points belong to no cluster."""
    edges = zero_shift_edges(shifts, grid).unionByName(shift_edges(shifts, grid)).drop("scan")
    return connected_components(edges, _fits_one_tile(grid)).select(F.col("node").alias("gid"), F.col("label").alias("cluster"))


def finalise(labels: DataFrame, shifts: DataFrame) -> DataFrame:
    """Members: original points only. Clusters that keep none disappear."""
    return shifts.where("is_original").join(labels, "gid")


def raw_values(members: DataFrame, points: DataFrame, names: list[str]) -> DataFrame:
    """Put the stored values back in place of the smoothed ones."""
    stored = points.select("gid", *[F.col(n).alias("_raw_" + n) for n in names])
    joined = members.join(stored, "gid", "left")
    return joined.withColumns({n: F.coalesce("_raw_" + n, n) for n in names}).drop(*["_raw_" + n for n in names])


def margin_flags(members: DataFrame, blocked: DataFrame, grid: Grid) -> DataFrame:
    """Clusters with a member next to an off-limits cell. ``blocked`` holds (scan, dims) of such cells."""
    near = moore_pairs(members.select("scan", "cluster", *grid.dims), blocked.select("scan", *grid.dims), grid.dims)
    return near.select("scan", "cluster").distinct()


def sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("scan", "cluster").agg(F.count("*").alias("size"))


def at_least(members: DataFrame, minimum: int) -> DataFrame:
    """Drop clusters below the minimum size."""
    if minimum <= 1:
        return members
    big = cut(sizes(members).where(F.col("size") >= minimum).select("cluster"))
    return attach(members, big, ["cluster"], "gid", part_of=big).select(*members.columns)


def large_labels(labels: DataFrame, shifts: DataFrame, minimum: int) -> DataFrame:
    """Labels of the clusters that :func:`at_least` leaves, found before the points' values are joined to them."""
    labels = cut(labels)
    big = cut(sizes(finalise(labels, shifts.select("scan", "gid", "is_original"))).where(F.col("size") >= minimum).select("cluster"))
    return attach(labels, big, ["cluster"], "gid", part_of=big).select("gid", "cluster")


def number_clusters(clusters: DataFrame, first_uuid: int = 0) -> DataFrame:
    """Consecutive uuid over all scans and consecutive id per scan, both in cluster order, starting at 1.

    ``clusters`` is read several times: pass a stored table.
    """
    numbered = number_rows(clusters, "cluster", "uuid")
    first = numbered.groupBy("scan").agg(F.min("uuid").alias("_first"))
    out = attach(numbered, first, ["scan"], "cluster", part_of=clusters)
    return out.withColumn("detection_id", F.col("uuid") - F.col("_first") + 1).withColumn(
        "uuid", F.col("uuid") + F.lit(first_uuid)
    ).drop("_first")


def cell_cover(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Shared cells of clusters over (pair, pid): ``current(pair, pid, n)`` with ``previous(pair, pid, m)``."""
    return current.join(previous, ["pair", "pid"]).groupBy("pair", "n", "m").agg(F.count("*").alias("shared"))


def merge_pair(a_mode: F.Column, b_mode: F.Column) -> F.Column:
    """Mode component of two merged clusters."""
    return (a_mode + b_mode) * 0.5


def adjacent_clusters(members: DataFrame, grid: Grid) -> DataFrame:
    """Pairs of clusters of one scan with adjacent members, and the number of adjacent member pairs."""
    slim = members.select("scan", "cluster", *grid.dims)
    pairs = moore_pairs(slim, slim, grid.dims).where("cluster < n_cluster")
    return pairs.groupBy("scan", "cluster", F.col("n_cluster").alias("neighbour")).agg(F.count("*").alias("contacts"))


def boundary_points(members: DataFrame, grid: Grid) -> DataFrame:
    """Members with a neighbour in another cluster."""
    slim = members.select("scan", "cluster", "gid", *grid.dims)
    pairs = moore_pairs(slim, slim, grid.dims).where("cluster <> n_cluster")
    return pairs.select("scan", "cluster", "gid").distinct()


def weight_tendency(points: DataFrame, grid: Grid) -> DataFrame:
    """Sum over the adjacent points of (their weight - own weight)."""
    slim = points.select("scan", "gid", *grid.dims, "w")
    pairs = moore_pairs(slim, slim, grid.dims)
    key = [c for c in pairs.columns if c.startswith("_b_")]
    return pairs.groupBy("scan", *key, "gid").agg(F.sum(F.col("n_w") - F.col("w")).alias("tendency")).drop(*key)


def coalesce(labels: DataFrame, points: DataFrame, grid: Grid) -> DataFrame:
    """Let every cluster join the cluster of its strongest adjacent outside point if that point is at least as strong as the
    cluster's own strongest; repeat on the result until nothing changes. All clusters decide at once per round.

    ``labels(gid, cluster)``; ``points`` with weights ``w``. An outside point without cluster wins no one.
    """
    weighted = points.select("scan", "gid", *grid.dims, "w")
    current = cut(labels)
    while True:
        tagged = weighted.join(current, "gid", "left")
        inside = tagged.where("cluster IS NOT NULL")
        own = inside.groupBy("cluster").agg(F.max("w").alias("own"))
        pairs = moore_pairs(inside, tagged, grid.dims).where("n_cluster IS NULL OR n_cluster <> cluster")
        best = pairs.where("n_w > 0").groupBy("cluster").agg(
            F.max_by(F.struct("n_cluster", "n_w"), F.struct("n_w", -F.col("n_gid"))).alias("b")
        )
        links = cut(
            best.join(own, "cluster")
            .where("b.n_w >= own AND b.n_cluster IS NOT NULL")
            .select(F.col("cluster").alias("src"), F.col("b.n_cluster").alias("dst"))
        )
        if links.isEmpty():
            return current
        # cluster labels have no tile: let the general contraction handle them
        edges = links.select("src", "dst", F.col("src").alias("src_tile"), F.col("dst").alias("dst_tile"))
        joined = connected_components(edges).select(F.col("node").alias("cluster"), F.col("label").alias("_to"))
        current = cut(
            current.join(joined, "cluster", "left").select("gid", F.coalesce("_to", "cluster").alias("cluster"))
        )


def consolidate_with_previous(cover: DataFrame, clusters: DataFrame, names: list[str], share: float = 0.33) -> DataFrame:
    """Mapping of current clusters to merge: those with at least ``share`` of their cells in one previous cluster that
    holds two or more such clusters.

    ``cover(pair, n, m, shared)``; ``clusters(cluster, size, <names>)``. Returns (pair, n, m, target, <names>): target is the
    smallest of the merged clusters, names are the mean of the modes.
    """
    held = (
        cover.join(clusters.select(F.col("cluster").alias("n"), "size", *names), "n")
        .where(F.col("shared") / F.col("size") >= F.lit(share))
    )
    # one row per current cluster within a previous one: never more than the previous cluster has cells
    w = Window.partitionBy("pair", "m")
    grouped = held.withColumn("_c", F.count("*").over(w)).where("_c > 1")
    merged = grouped.withColumn("target", F.min("n").over(w))
    for c in names:
        merged = merged.withColumn(c, F.avg(c).over(w))
    return merged.select("pair", "n", "m", "target", *names)


def consolidated_groups(mapping: DataFrame, members: DataFrame, names: list[str]) -> DataFrame:
    """Merged clusters from the mapping of :func:`consolidate_with_previous`: (pair, n, label, <names>).

    Each previous cluster makes one merged cluster of all its parts, so a part held by two previous clusters is in two merged ones.
    Previous clusters with the same parts make one. ``label`` is a cell of the smallest part: its own label for the first merged cluster that
    starts with it, its second cell for the next. If such a part has fewer cells than merged clusters, the last ones become one.
    """
    mapping = cut(mapping)
    parts = mapping.groupBy("pair", "m").agg(
        F.min("target").alias("target"), F.count("*").alias("_n"), F.max("n").alias("_last"),
        F.sum(F.xxhash64("n").cast("decimal(38,0)")).alias("_parts"), *[F.first(c).alias(c) for c in names],
    )
    same = Window.partitionBy("pair", "target", "_n", "_last", "_parts").orderBy("m")
    own = parts.withColumn("_same", F.row_number().over(same)).where("_same = 1")
    turn = F.row_number().over(Window.partitionBy("pair", "target").orderBy("m"))
    own = cut(own.select("pair", "m", "target", turn.alias("_turn"), *names))
    # only targets that start several merged clusters need more cells than their label
    again = own.groupBy(F.col("target").alias("cluster")).agg(F.max("_turn").alias("_most")).where("_most > 1")
    cells = attach(members.select("cluster", "gid"), again, ["cluster"], "gid", part_of=own)
    nth = cells.withColumn("_turn", F.row_number().over(Window.partitionBy("cluster").orderBy("gid"))).where("_turn <= _most")
    held = nth.groupBy("cluster").agg(F.max("_turn").alias("_cells"))
    counted = own.join(held.withColumnRenamed("cluster", "target"), "target", "left")
    counted = counted.withColumn("_turn", F.least("_turn", F.coalesce("_cells", F.lit(1))))
    place = nth.select(F.col("cluster").alias("target"), "_turn", "gid")
    labelled = counted.join(place, ["target", "_turn"], "left")
    first = F.when(F.col("_turn") == 1, F.col("target")).otherwise(F.col("gid")).alias("label")
    labelled = cut(labelled.select("pair", "m", first, *names))
    modes = labelled.groupBy("pair", "label").agg(*[F.min_by(c, "m").alias(c) for c in names])
    held_by = mapping.select("pair", "n", "m").join(labelled.select("pair", "m", "label"), ["pair", "m"])
    return held_by.select("pair", "n", "label").distinct().join(modes, ["pair", "label"]).select("pair", "n", "label", *names)


def mean_neighbour_shift(shifts: DataFrame, grid: Grid, names: list[str]) -> DataFrame:
    """Option: replace zero shifts by the mean shift of the adjacent points (the point itself counts in the divisor)."""
    comps = ["s_" + d for d in grid.dims] + ["s_" + n for n in names]
    slim = shifts.select("scan", "gid", *grid.dims, *comps)
    still = shifts.where("zero_shift").select("scan", "gid", *grid.dims)
    pairs = moore_pairs(still, slim, grid.dims)
    other = F.col("gid") != F.col("n_gid")
    key = [c for c in pairs.columns if c.startswith("_b_")]
    mean = pairs.groupBy("scan", *key, "gid").agg(
        *[(F.sum(F.when(other, F.col("n_" + c)).otherwise(0.0)) / F.count("*")).alias("_m_" + c) for c in comps]
    ).drop(*key, "scan")
    joined = shifts.join(mean, "gid", "left")
    new = {c: F.coalesce("_m_" + c, c) for c in comps}
    out = joined.withColumns(new)
    still_zero = F.lit(True)
    for d, r in zip(grid.dims, grid.resolution):
        out = out.withColumn("g_" + d, F.round(F.round(F.col("s_" + d), 6) / r).cast("int"))
        out = out.withColumn("s_" + d, F.col("g_" + d) * F.lit(r))
        still_zero = still_zero & (F.col("g_" + d) == 0)
    return out.withColumn("zero_shift", still_zero).select(*shifts.columns)


def add_strongest_neighbour(labels: DataFrame, points: DataFrame, grid: Grid) -> DataFrame:
    """Option: each cluster takes in its strongest adjacent free point if that beats its own strongest."""
    tagged = points.select("scan", "gid", *grid.dims, "w").join(labels, "gid", "left")
    inside = tagged.where("cluster IS NOT NULL")
    own = inside.groupBy("cluster").agg(F.max("w").alias("own"))
    pairs = moore_pairs(inside, tagged, grid.dims)
    best = pairs.groupBy("cluster").agg(
        F.max_by(F.struct("n_gid", "n_w", "n_cluster"), F.struct("n_w", -F.col("n_gid"))).alias("b")
    )
    taken = best.join(own, "cluster").where("b.n_w > own AND b.n_cluster IS NULL").select(F.col("b.n_gid").alias("gid"), "cluster")
    return labels.unionByName(taken.groupBy("gid").agg(F.min("cluster").alias("cluster")))


def erase_ids(clusters: DataFrame) -> DataFrame:
    """Clusters without identity."""
    none = F.lit(None).cast("bigint")
    return clusters.withColumns({"id": none, "uuid": none})


def reset_membership(members: DataFrame) -> DataFrame:
    """Points that belong to no cluster."""
    return members.withColumn("cluster", F.lit(None).cast("bigint"))
