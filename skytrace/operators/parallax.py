"""Parallax correction of gridded satellite fields: move each cell, then fill the holes it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytrace.operators.neighbours import keys, near_pairs
from skytrace.params import Grid

FILL_BELOW, FILL_ABOVE, FILL_MINIMUM = 2, 1, 8


def scatter(cells: DataFrame, grid: Grid, new_index: dict[str, str], value: str) -> DataFrame:
    """Write every cell's value to its new index; the last source in grid order wins, cells leaving the grid
    go to the first cell."""
    inside = F.lit(True)
    for d, n in zip(grid.dims, grid.sizes):
        inside = inside & F.col(new_index[d]).between(0, n - 1)
    moved = cells.select(
        "scan", *[F.when(inside, F.col(new_index[d])).otherwise(0).cast("int").alias("_n_" + d) for d in grid.dims],
        F.struct(*grid.dims).alias("_from"), value,
    )
    out = moved.groupBy("scan", *["_n_" + d for d in grid.dims]).agg(F.max_by(value, "_from").alias(value))
    return out.select("scan", *[F.col("_n_" + d).alias(d) for d in grid.dims], value)


def fill_holes(filled: DataFrame, every_cell: DataFrame, grid: Grid, value: str, categorical: bool = False) -> DataFrame:
    """Fill cells without a value from the window [-2, +1] per dimension if it has at least eight values.

    Continuous variables take the mean, class variables the most frequent value (smallest on ties).
    Filled cells do not feed further fills.
    """
    on = ["scan", *grid.dims]
    holes = every_cell.select(*on).join(filled.select(*on), on, "left_anti")
    pairs = near_pairs(holes, filled.select(*on, value), {d: FILL_BELOW for d in grid.dims})
    for d in grid.dims:
        pairs = pairs.where((F.col("n_" + d) >= F.col(d) - FILL_BELOW) & (F.col("n_" + d) <= F.col(d) + FILL_ABOVE))
    key = [*keys(grid.dims), *grid.dims]
    v = "n_" + value
    if categorical:
        counts = pairs.groupBy(*key, v).agg(F.count("*").alias("_c"))
        w = Window.partitionBy(*key)
        best = counts.withColumn("_n", F.sum("_c").over(w)).withColumn(
            "_r", F.row_number().over(w.orderBy(F.desc("_c"), F.asc(v)))
        )
        new = best.where((F.col("_r") == 1) & (F.col("_n") >= FILL_MINIMUM)).select(*on, F.col(v).alias(value))
    else:
        new = (
            pairs.groupBy(*key).agg(F.avg(v).alias(value), F.count("*").alias("_n"))
            .where(F.col("_n") >= FILL_MINIMUM).select(*on, value)
        )
    return filled.select(*on, value).unionByName(new.withColumn(value, F.col(value).cast(filled.schema[value].dataType)))
