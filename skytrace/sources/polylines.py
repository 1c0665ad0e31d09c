"""Polylines on a grid: clipped at the domain, cut into parts where they leave it, walked cell by cell.

A vertex finds its successor by an equi-join on its number, and parts are numbered by block sums, so a line of any length is spread over
many tasks. Segments whose bounding box misses the domain end at a filter, before anything is computed for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytrace.sources.files import line_cells

BLOCK = 1024  # vertices of a line that are numbered together


def segments(vertices: DataFrame) -> DataFrame:
    """(line, seq, x0, y0, x1, y1): each vertex with its successor. ``vertices(line, seq, x, y)``, numbered without gaps within a line."""
    ahead = vertices.select("line", (F.col("seq") - 1).alias("seq"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return vertices.select("line", "seq", F.col("x").alias("x0"), F.col("y").alias("y0")).join(ahead, ["line", "seq"])


def _cut(p: Column, q: Column) -> tuple[Column, Column]:
    """Share of a segment at which it enters and leaves one half-plane, where ``q`` is the distance from the edge and ``p`` the way towards it."""
    inside = F.when(q < 0, F.lit(2.0)).otherwise(F.lit(0.0))
    return F.when(p < 0, q / p).when(p == 0, inside).otherwise(F.lit(0.0)), F.when(p > 0, q / p).otherwise(F.lit(1.0))


def clipped(segs: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """The segments' pieces inside ``box`` = (x_min, x_max, y_min, y_max), its edge included, with ``enters``: whether the
    piece begins at the edge and not at a vertex inside."""
    x_min, x_max, y_min, y_max = (F.lit(float(v)) for v in box)
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    near = (F.least(x0, x1) <= x_max) & (F.greatest(x0, x1) >= x_min) & (F.least(y0, y1) <= y_max) & (F.greatest(y0, y1) >= y_min)
    dx, dy = x1 - x0, y1 - y0
    cuts = [_cut(-dx, x0 - x_min), _cut(dx, x_max - x0), _cut(-dy, y0 - y_min), _cut(dy, y_max - y0)]
    both = segs.where(near).withColumns({"_t0": F.greatest(F.lit(0.0), *[a for a, _ in cuts]), "_t1": F.least(F.lit(1.0), *[b for _, b in cuts])}).where("_t0 <= _t1")
    at = lambda start, way, t: F.least(F.greatest(start + F.col(t) * way[0], way[1]), way[2])
    ends = {"x0": at(x0, (dx, x_min, x_max), "_t0"), "y0": at(y0, (dy, y_min, y_max), "_t0"), "x1": at(x0, (dx, x_min, x_max), "_t1"), "y1": at(y0, (dy, y_min, y_max), "_t1")}
    return both.withColumns({**ends, "enters": F.col("_t0") > 0}).drop("_t0", "_t1")


def parts(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the number of the part they belong to, from 0 in each line: a new one where the line enters the domain, and at its first vertex."""
    begins = pieces.withColumn("_begin", (F.col("enters") | (F.col("seq") == 0)).cast("long")).withColumn("_block", F.floor(F.col("seq") / BLOCK))
    sums = begins.groupBy("line", "_block").agg(F.sum("_begin").alias("_held"))
    before = Window.partitionBy("line").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("line", "_block", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("line", "_block").orderBy("seq")
    numbered = begins.withColumn("_run", F.sum("_begin").over(within)).join(ahead, ["line", "_block"])
    return numbered.withColumn("part", F.col("_run") + F.col("_ahead") - 1).drop("_begin", "_block", "_run", "_ahead", "enters")


def polyline_cells(vertices: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """(line, part, x, y): the distinct cells that each part of each line covers on a grid of ``sizes`` = (columns, rows).

    Vertices are in grid units, cell centres at whole numbers; a line is cut exactly where it crosses the outermost centres. A line
    of one vertex covers nothing; one that only touches the edge covers that cell.
    """
    box = (0.0, sizes[0] - 1.0, 0.0, sizes[1] - 1.0)
    whole = {c: F.floor(F.col(c) + 0.5).cast("bigint") for c in ("x0", "y0", "x1", "y1")}
    return line_cells(parts(clipped(segments(vertices), box)).withColumns(whole)).select("line", "part", "x", "y").distinct()
