"""Mean-shift vectors, gridded shifts and iterated trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.functions.kernels import Kernel
from skytrace.operators.featurespace import round_to_grid, to_gridpoints
from skytrace.operators.neighbours import ellipsoid_pairs, home_blocks, keys
from skytrace.params import Grid
from skytrace.session import cut

# Shifts are snapped to this many digits before rounding to the grid, so that sums which differ
# only by the order of their terms fall on the same side of a half cell.
DIGITS = 6


def shift_vectors(
    points: DataFrame,
    grid: Grid,
    names: list[str],
    ranges: tuple[float, ...],
    kernel: Kernel | None,
    size: float,
    weight: str | None = "w",
    search: DataFrame | None = None,
    normalise: bool = True,
) -> DataFrame:
    """One mean-shift vector per point: weighted mean of the ellipsoid neighbours minus the point.

    Adds ``s_<dim>``, ``s_<var>`` (raw shift; spatial part rounded to the grid if ``normalise``), ``g_<dim>``
    (grid offset) and ``zero_shift``. The kernel receives the squared scaled distance. Without
    neighbours or with zero total weight the shift is zero.
    """
    columns = ["c_" + d for d in grid.dims] + names
    other = search if search is not None else points
    neighbour_cols = ["scan", *grid.dims, *columns, *([weight] if weight else [])]
    reach = grid.reach(tuple(ranges[: len(grid.dims)]))
    if search is not None:
        # positions between grid lines sit up to half a cell from their index
        reach = {d: n + 1 for d, n in reach.items()}
    pairs = ellipsoid_pairs(points, other.select(*neighbour_cols), reach, columns, list(ranges))
    mass = _mass(F.col("d2"), kernel, size, F.col("n_" + weight) if weight else None)
    own = [c for c in points.columns if c not in keys(grid.dims)]
    sums = pairs.withColumn("_m", mass).groupBy(*keys(grid.dims), *own).agg(
        F.sum("_m").alias("_total"), *[F.sum(F.col("_m") * F.col("n_" + c)).alias("_s_" + c) for c in columns]
    )
    out = sums
    for c in columns:
        mean = F.try_divide(F.col("_s_" + c), F.when(F.col("_total") != 0, F.col("_total")))
        out = out.withColumn("_d_" + c, F.coalesce(mean - F.col(c), F.lit(0.0)))
    snapped = {d: F.round(F.col("_d_c_" + d), DIGITS) for d in grid.dims}
    result = {}
    for d, r in zip(grid.dims, grid.resolution):
        result["s_" + d] = round_to_grid(snapped[d], r) if normalise else F.col("_d_c_" + d)
        result["g_" + d] = to_gridpoints(snapped[d], r)
    for v in names:
        result["s_" + v] = F.col("_d_" + v)
    out = out.select(*points.columns, *[c.alias(n) for n, c in result.items()])
    still = F.lit(True)
    for d in grid.dims:
        still = still & (F.col("g_" + d) == 0)
    return out.withColumn("zero_shift", still)


def _mass(d2: Column, kernel: Kernel | None, size: float, weight: Column | None) -> Column:
    k = None if kernel is None else kernel(d2, size)
    if k is not None and weight is not None:
        return k * weight
    if k is not None:
        return k
    return weight if weight is not None else F.lit(1.0)


def iterate(
    seeds: DataFrame,
    points: DataFrame,
    grid: Grid,
    names: list[str],
    ranges: tuple[float, ...],
    kernel: Kernel | None,
    size: float,
    weight: str | None = None,
    epsilon: float = 0.01,
    max_iterations: int = 1000,
) -> DataFrame:
    """Move every seed along its mean-shift vector until the step is shorter than ``epsilon``.

    Returns the whole trajectory: (scan, seed, step, c_<dim>.., <var>.., shift_norm). Only seeds still moving take part
    in a round, so late rounds are small; each round is one range join. The points are dealt out to their blocks once and kept there; a
    round moves nothing but its seeds, copied to the blocks they reach.
    """
    columns = ["c_" + d for d in grid.dims] + names
    # positions between grid lines sit up to half a cell from their index
    reach = {d: n + 1 for d, n in grid.reach(tuple(ranges[: len(grid.dims)])).items()}
    slim = home_blocks(points.select("scan", *grid.dims, *columns, *([weight] if weight else [])), reach)
    dealt = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    search = slim.repartition(dealt, *keys(grid.dims)).persist()
    position = cut(seeds.select("scan", "seed", *columns))
    parts = [position.withColumn("step", F.lit(0)).withColumn("shift_norm", F.lit(None).cast("double"))]
    for step in range(1, max_iterations + 1):
        nxt = cut(_moved(position, search, grid, columns, reach, ranges, kernel, size, weight))
        parts.append(nxt.withColumn("step", F.lit(step)))
        position = nxt.where(F.col("shift_norm") >= epsilon).drop("shift_norm")
        if position.isEmpty():
            break
    search.unpersist()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _moved(
    position: DataFrame, search: DataFrame, grid: Grid, columns: list[str], reach: dict[str, float], ranges: tuple[float, ...],
    kernel: Kernel | None, size: float, weight: str | None,
) -> DataFrame:
    """Seeds at the weighted mean of the points around them, with the length of the step. A seed without neighbours drops out:
    its shift is zero and it has converged."""
    cells = position
    for d, o, r in zip(grid.dims, grid.origin, grid.resolution):
        cells = cells.withColumn(d, F.round((F.col("c_" + d) - F.lit(o)) / F.lit(r)).cast("int"))
    pairs = ellipsoid_pairs(search, cells, reach, columns, list(ranges), blocked=True)
    mass = _mass(F.col("d2"), kernel, size, F.col(weight) if weight else None)
    sums = pairs.withColumn("_m", mass).groupBy("scan", F.col("n_seed").alias("seed"), *["n_" + c for c in columns]).agg(
        F.sum("_m").alias("_total"), *[F.sum(F.col("_m") * F.col(c)).alias("_s_" + c) for c in columns]
    )
    mean = {c: F.try_divide(F.col("_s_" + c), F.when(F.col("_total") != 0, F.col("_total"))) for c in columns}
    shifted = sums.withColumns({"_d_" + c: F.coalesce(m - F.col("n_" + c), F.lit(0.0)) for c, m in mean.items()})
    total = F.lit(0.0)
    for c in columns:
        total = total + F.col("_d_" + c) * F.col("_d_" + c)
    new = [(F.col("n_" + c) + F.col("_d_" + c)).alias(c) for c in columns]
    return shifted.select("scan", "seed", *new, F.sqrt(total).alias("shift_norm"))


def iterate_end(trajectory: DataFrame) -> DataFrame:
    """End point of each trajectory and its number of steps."""
    others = [c for c in trajectory.columns if c not in ("scan", "seed", "step")]
    last = trajectory.groupBy("scan", "seed").agg(F.max_by(F.struct(*others, "step"), "step").alias("e"))
    return last.select("scan", "seed", *[F.col("e." + c).alias(c) for c in others], F.col("e.step").alias("steps"))
