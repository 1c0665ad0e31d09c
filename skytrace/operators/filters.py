"""Neighbourhood filters on the feature space: smoothing, replacement, convection and coldest-quartile."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.operators.featurespace import coordinates, global_id, linear_index
from skytrace.operators.neighbours import block_column, ellipsoid_pairs, keys, near_pairs
from skytrace.params import Grid, scale_to_filter_width


def smoothing_taps(scale: float, resolution: float) -> list[float]:
    """Gaussian values at index distances 0, 1, ...; fewer than one tap leaves nothing to smooth with."""
    taps = int(scale_to_filter_width(scale) / resolution)
    gauge = 1.0 / math.sqrt(2.0 * math.pi * scale)
    return [gauge * math.exp(-((j * resolution) ** 2) / (2.0 * scale)) for j in range(taps)]


def scale_space(points: DataFrame, grid: Grid, names: list[str], scale: float, symmetric: bool = True) -> DataFrame:
    """Separable Gaussian smoothing, one dimension at a time, without renormalisation.

    Cells that had no point but lie within reach of one become points with ``is_original`` false. With
    ``symmetric=False`` the upper neighbour at full reach and the last grid line are left out, which
    reproduces the asymmetric window of existing runs.

    Per dimension one shuffle moves each point to the blocks its reach touches; the taps are expanded after
    that shuffle and summed inside the block.
    """
    carried = [c for c in ("scan", "ts") if c in points.columns]
    current = points.select(*carried, *grid.dims, *names, "is_original")
    for d, n, res in zip(grid.dims, grid.sizes, grid.resolution):
        current = _smooth_dimension(current, grid, names, d, n, smoothing_taps(scale, res), symmetric)
    return coordinates(current, grid).withColumn("pid", linear_index(grid)).withColumn("gid", global_id(grid))


def _smooth_dimension(
    df: DataFrame, grid: Grid, names: list[str], d: str, size: int, taps: list[float], symmetric: bool
) -> DataFrame:
    reach = len(taps) - 1
    if reach < 0:  # narrower than a cell: nothing to smooth along this dimension
        return df
    side = max(16, 4 * reach)
    others = [o for o in grid.dims if o != d]
    line = ["scan", *others, "_block"]
    source = df if symmetric else df.where(F.col(d) < size - 1)
    # targets of source i: from i - reach to i + reach (a target's window mirrors this)
    low = F.greatest(F.col(d) - (reach if symmetric else reach - 1), F.lit(0))
    high = F.least(F.col(d) + reach, F.lit(size - 1))
    spread = source.withColumn(
        "_block", F.explode(F.sequence(F.floor(low / side).cast("int"), F.floor(high / side).cast("int")))
    ).repartition(*[F.col(c) for c in line])
    first = F.greatest(low, F.col("_block") * side)
    last = F.least(high, (F.col("_block") + 1) * side - 1)
    kernel = F.lit([float(t) for t in taps])
    hit = spread.withColumn("_target", F.explode(F.sequence(first.cast("int"), last.cast("int")))).withColumn(
        "_k", F.element_at(kernel, (F.abs(F.col("_target") - F.col(d)) + 1).cast("int"))
    )
    same = F.col("_target") == F.col(d)
    aggs = [F.sum(F.col("_k") * F.col(v)).alias(v) for v in names]
    aggs.append(F.max(F.when(same, F.col("is_original")).otherwise(F.lit(False))).alias("is_original"))
    if "ts" in df.columns:
        aggs.append(F.max("ts").alias("ts"))
    out = hit.groupBy(*line, "_target").agg(*aggs).withColumnRenamed("_target", d).drop("_block")
    return out if symmetric else _restore_original_flag(out, df, grid)


def _restore_original_flag(out: DataFrame, df: DataFrame, grid: Grid) -> DataFrame:
    """The asymmetric window may miss a point's own cell; take its flag from the input."""
    on = ["scan", *grid.dims]
    before = df.select(*on, F.col("is_original").alias("_was"))
    joined = out.join(before, on, "left")
    return joined.withColumn("is_original", F.coalesce("_was", F.lit(False))).drop("_was")


def range_factors(before: DataFrame, after: DataFrame, names: list[str]) -> DataFrame:
    """Filtered value range over unfiltered value range per variable and scan."""
    span = lambda df, tag: df.groupBy("scan").agg(*[(F.max(n) - F.min(n)).alias(n + tag) for n in names])
    joined = span(before, "_b").join(span(after, "_a"), "scan")
    return joined.select("scan", *[F.try_divide(F.col(n + "_a"), F.col(n + "_b")).alias(n + "_factor") for n in names])


def replacement(
    points: DataFrame, grid: Grid, variable: str, mode: str, fraction: float, ranges: tuple[float, ...], columns: list[str]
) -> DataFrame:
    """Replace a variable by the mean of the lowest or highest share of its ellipsoid neighbours, or by the
    middle one. Neighbour lists are bounded by the cells an ellipsoid covers."""
    spatial = tuple(ranges[: len(grid.dims)])
    other = points.select("scan", *grid.dims, *columns)
    pairs = ellipsoid_pairs(points, other, grid.reach(spatial), columns, list(ranges))
    key = keys(grid.dims)
    rest = [c for c in points.columns if c not in key]
    lists = pairs.groupBy(*key, *rest).agg(F.array_sort(F.collect_list("n_" + variable)).alias("_vs"))
    n = F.round(F.size("_vs") * F.lit(float(fraction))).cast("int")
    if mode == "median":
        # fraction 1 is the upper median, as position n // 2 of the sorted values
        value = F.element_at("_vs", (F.floor(n / 2) + 1).cast("int"))
    else:
        part = F.slice("_vs", 1, n) if mode == "lowest" else F.slice(F.reverse("_vs"), 1, n)
        total = F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x)
        value = F.when(n > 0, total / F.greatest(n, F.lit(1)))
    replaced = F.coalesce(value, F.col(variable)) if mode != "median" else value
    return lists.withColumn(variable, replaced).select(*points.columns)


CONVECTIVE_THRESHOLD = 40.0
CRITICAL_EXCESS = 4.5
CONVECTIVE_RADIUS_FACTOR = 0.2


def background_excess(z_background: Column) -> Column:
    """Intensity a point must exceed its background by to count as convective."""
    curve = F.lit(10.0) - z_background * z_background / F.lit(180.0)
    return F.when((z_background >= 0) & (z_background <= CONVECTIVE_THRESHOLD), curve).otherwise(F.lit(10.0))


def convection(
    points: DataFrame,
    grid: Grid,
    variable: str,
    ranges: tuple[float, ...],
    erase: bool = True,
    published_criterion: bool = False,
    radius_factor: float = CONVECTIVE_RADIUS_FACTOR,
) -> DataFrame:
    """Steiner-Houze-Yuter convective/stratiform separation.

    A point is convective if it reaches the threshold, or if its background's excess curve is above
    the critical value (with ``published_criterion``: if it exceeds its background by the curve).
    Points within the convective radius of one are kept; others are dropped, or set to zero.
    """
    spatial = tuple(ranges[: len(grid.dims)])
    cols = ["c_" + d for d in grid.dims]
    key = keys(grid.dims)
    slim = points.select("scan", *grid.dims, *cols, variable)
    around = ellipsoid_pairs(slim, slim, grid.reach(spatial), cols, list(spatial))
    background = around.groupBy(*key, *grid.dims, *cols, variable).agg(F.avg("n_" + variable).alias("_bg"))
    z = F.col(variable)
    excess = background_excess(F.col("_bg"))
    by_background = (z - F.col("_bg") >= excess) if published_criterion else (excess > CRITICAL_EXCESS)
    centres = background.where((z >= CONVECTIVE_THRESHOLD) | by_background).select("scan", *grid.dims, *cols)
    small = tuple(radius_factor * h for h in spatial)
    near = ellipsoid_pairs(centres, points.select("scan", *grid.dims, *cols), grid.reach(small), cols, list(small))
    marked = near.select("scan", *[F.col("n_" + d).alias(d) for d in grid.dims]).distinct()
    on = ["scan", *grid.dims]
    if erase:
        return points.join(marked, on, "left_semi")
    flagged = points.join(marked.withColumn("_m", F.lit(True)), on, "left")
    return flagged.withColumn(variable, F.when(F.col("_m"), z).otherwise(F.lit(0.0))).select(*points.columns)


def coldest_shares(cells: DataFrame, grid: Grid, variables: list[str], reach: dict[str, int], fraction: float = 0.25) -> DataFrame:
    """Replace stored variables by the mean of the lowest share of the values in an index box, all in one search.

    Only valid values take part; where the share is less than half a value, nothing is left (NULL).
    """
    slim = cells.select("scan", *grid.dims, *variables)
    boxes = [F.array_sort(F.collect_list("n_" + v)).alias("_" + v) for v in variables]
    lists = near_pairs(slim, slim, reach).groupBy(*keys(grid.dims), *grid.dims).agg(*boxes)

    def coldest(v: str) -> Column:
        n = F.round(F.size("_" + v) * F.lit(float(fraction))).cast("int")
        total = F.aggregate(F.slice("_" + v, 1, n), F.lit(0.0), lambda acc, x: acc + x)
        return F.when(n > 0, total / F.greatest(n, F.lit(1))).alias(v)

    return lists.select("scan", *grid.dims, *[coldest(v) for v in variables])


def coldest_share(cells: DataFrame, grid: Grid, variable: str, reach: dict[str, int], fraction: float = 0.25) -> DataFrame:
    """:func:`coldest_shares` of one variable."""
    return coldest_shares(cells, grid, [variable], reach, fraction)


def weight_between(weighted: DataFrame, lower: float, upper: float | None) -> DataFrame:
    """Weight filter, applied only if a limit differs from its default."""
    if lower == 0 and upper is None:
        return weighted
    out = weighted.where(F.col("w") >= F.lit(float(lower)))
    return out if upper is None else out.where(F.col("w") <= F.lit(float(upper)))


def box_values(cells: DataFrame, grid: Grid, variable: str, reach: dict[str, int]) -> DataFrame:
    """All values in an index box around every cell, clipped at the borders, as one sorted array per cell."""
    slim = cells.select("scan", *grid.dims, variable)
    pairs = near_pairs(slim, slim, reach)
    return pairs.groupBy(*keys(grid.dims), *grid.dims).agg(F.array_sort(F.collect_list("n_" + variable)).alias("box")).drop(
        *[block_column(d) for d in grid.dims]
    )
