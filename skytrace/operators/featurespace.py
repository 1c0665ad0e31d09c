"""Feature space: unpacking, validity, thresholds, coordinates and row-level projections.

Raw cells carry one ``<var>_raw`` column per variable; points carry grid indices, coordinates ``c_<dim>``
and unpacked values ``<var>``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.params import Grid


@dataclass(frozen=True)
class Variable:
    """Packing and limits of one stored variable. Limits and fill value are in packed units."""

    name: str
    scale_factor: float = 1.0
    add_offset: float = 0.0
    valid_min: float = 0.0
    valid_max: float = 0.0
    fill_value: float | None = None

    @property
    def limits(self) -> tuple[float, float]:
        """Unpacked valid range."""
        return (
            self.scale_factor * self.valid_min + self.add_offset,
            self.scale_factor * self.valid_max + self.add_offset,
        )


def unpack_value(raw: Column, var: Variable) -> Column:
    return F.lit(float(var.scale_factor)) * raw + F.lit(float(var.add_offset))


def pack_value(value: Column, var: Variable) -> Column:
    return (value - F.lit(float(var.add_offset))) / F.lit(float(var.scale_factor))


def is_valid(raw: Column, var: Variable) -> Column:
    """With a fill value only equality with it is tested; without one everything present is valid."""
    present = raw.isNotNull()
    return present if var.fill_value is None else present & (raw != F.lit(var.fill_value))


def is_in_range(raw: Column, var: Variable) -> Column:
    if var.fill_value is not None:
        return is_valid(raw, var)
    return raw.isNotNull() & (raw >= F.lit(var.valid_min)) & (raw <= F.lit(var.valid_max))


def unpack(cells: DataFrame, variables: list[Variable]) -> DataFrame:
    """Add ``<var>``, ``<var>_valid`` and ``<var>_in_range`` for every ``<var>_raw``."""
    added = {}
    for v in variables:
        raw = F.col(v.name + "_raw")
        added[v.name] = unpack_value(raw, v)
        added[v.name + "_valid"] = is_valid(raw, v)
        added[v.name + "_in_range"] = is_in_range(raw, v)
    return cells.withColumns(added)


def off_limits(variables: list[Variable]) -> Column:
    """A cell is off limits if any variable is invalid there."""
    valid = [is_valid(F.col(v.name + "_raw"), v) for v in variables]
    return ~reduce(lambda a, b: a & b, valid)


def coordinates(df: DataFrame, grid: Grid) -> DataFrame:
    """Grid index to coordinate on a regular grid: pure column math, no axis join."""
    return df.withColumns(
        {"c_" + d: F.lit(float(o)) + F.col(d) * F.lit(float(r)) for d, o, r in zip(grid.dims, grid.origin, grid.resolution)}
    )


def coordinates_from_axis(df: DataFrame, axis: DataFrame, grid: Grid) -> DataFrame:
    """Grid index to coordinate on a rectilinear grid through ``axis(dim, idx, coord)``.

    An axis has one row per grid line, i.e. at most the size of the dimension.
    """
    for d, size in zip(grid.dims, grid.sizes):
        line = axis.where(F.col("dim") == d).select(F.col("idx").cast("int").alias(d), F.col("coord").alias("c_" + d))
        df = df.join(F.broadcast(line) if size <= 100_000 else line, d)
    return df


def reverse_lookup(coord: Column, grid: Grid, dim: str) -> Column:
    """Coordinate to grid index; NULL outside the grid."""
    i = grid.dims.index(dim)
    idx = F.round((coord - F.lit(grid.origin[i])) / F.lit(grid.resolution[i])).cast("int")
    return F.when((idx >= 0) & (idx < grid.sizes[i]), idx)


def round_to_grid(value: Column, resolution: float) -> Column:
    """Nearest multiple of the resolution, halves away from zero."""
    return F.round(value / F.lit(float(resolution))) * F.lit(float(resolution))


def to_gridpoints(value: Column, resolution: float) -> Column:
    return F.round(value / F.lit(float(resolution))).cast("int")


def to_meters(value: Column, units: str) -> Column:
    return value * F.lit(1000.0 if units == "km" else 1.0)


def linear_index(grid: Grid, prefix: str = "") -> Column:
    """Row-major index of a grid point, slowest dimension first."""
    terms = [F.col(prefix + d).cast("bigint") * F.lit(s) for d, s in zip(grid.dims, grid.strides)]
    return reduce(lambda a, b: a + b, terms).cast("bigint")


def grid_point(pid: Column, grid: Grid) -> dict[str, Column]:
    """Inverse of :func:`linear_index`."""
    return {
        d: (F.floor(pid / F.lit(s)) % F.lit(n)).cast("int") for d, s, n in zip(grid.dims, grid.strides, grid.sizes)
    }


def global_id(grid: Grid) -> Column:
    """One BIGINT per (scan, cell); orders like (scan, pid)."""
    return (F.col("scan") * F.lit(grid.cells) + F.col("pid")).cast("bigint")


def build(
    cells: DataFrame,
    grid: Grid,
    variables: list[Variable],
    lower: dict[str, float] | None = None,
    upper: dict[str, float] | None = None,
    replacement: dict[str, float] | None = None,
) -> DataFrame:
    """Accepted cells as points. A value that is missing, out of range or outside its thresholds is replaced
    if a replacement is given for the variable, otherwise the whole point is discarded."""
    lower, upper, replacement = lower or {}, upper or {}, replacement or {}
    values, accept = {}, F.lit(True)
    for v in variables:
        raw = F.col(v.name + "_raw")
        value = unpack_value(raw, v)
        ok = is_valid(raw, v) & is_in_range(raw, v)
        if v.name in lower:
            ok = ok & (value >= F.lit(float(lower[v.name])))
        if v.name in upper:
            ok = ok & (value <= F.lit(float(upper[v.name])))
        if v.name in replacement:
            values[v.name] = F.when(ok, value).otherwise(F.lit(float(replacement[v.name])))
        else:
            accept = accept & ok
            values[v.name] = value
    keep = [c for c in ("scan", "ts") if c in cells.columns]
    accepted = cells.where(accept).select(*keep, *grid.dims, *[c.alias(n) for n, c in values.items()])
    points = coordinates(accepted, grid).withColumn("pid", linear_index(grid))
    return points.withColumn("gid", global_id(grid)).withColumn("is_original", F.lit(True))


def value_ranges(points: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Observed minimum and maximum per variable."""
    aggs = [f(n).alias(f"{n}_{s}") for n in names for f, s in ((F.min, "min"), (F.max, "max"))]
    return points.groupBy(*(by or [])).agg(*aggs)


def threshold_all(points: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Keep points with every listed feature component at or above its threshold."""
    return points.where(reduce(lambda a, b: a & b, [F.col(c) >= F.lit(float(t)) for c, t in thresholds.items()]))


def count_original(points: DataFrame) -> DataFrame:
    return points.groupBy("scan").agg(F.count_if("is_original").alias("n_original"), F.count("*").alias("n_points"))
