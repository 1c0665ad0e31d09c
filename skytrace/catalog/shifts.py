"""Kernels, mean-shift vectors and trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytrace.catalog.base import CTES, query
from skytrace.catalog.neighbourhoods import _D2, _ellipsoid
from skytrace.catalog.scans import r, up
from skytrace.functions import kernels
from skytrace.operators import meanshift
from skytrace.sources import tables as tb


@query("k_gauss", "SELECT scan, pid, n_pid, round(exp(-5e-1 * d2) * 5e-1, 6) AS k FROM near")
def k_gauss(w):
    return _ellipsoid(w).select("scan", "pid", "n_pid", r(kernels.gauss(F.col("d2")), "k"))


@query("k_epanechnikov", "SELECT scan, pid, n_pid, round(CASE WHEN d2 <= 6e-1 THEN 6e-1 - d2 ELSE 0e0 END, 6) AS k FROM near")
def k_epanechnikov(w):
    return _ellipsoid(w).select("scan", "pid", "n_pid", r(kernels.epanechnikov(F.col("d2"), 0.6), "k"))


@query("k_uniform", "SELECT scan, pid, n_pid, round(CASE WHEN abs(d2) <= 6e-1 THEN 1e0 / 6e-1 ELSE 0e0 END, 6) AS k FROM near")
def k_uniform(w):
    return _ellipsoid(w).select("scan", "pid", "n_pid", r(kernels.uniform(F.col("d2"), 0.6), "k"))


CTES["raw_near"] = f"""
SELECT a.scan, a.pid, a.c_y, a.c_x, a.v, a.u, b.c_y AS n_y, b.c_x AS n_x, b.v AS n_v, b.u AS n_u, b.w AS n_w, {_D2} AS d2 FROM weighted a JOIN weighted b
ON a.scan = b.scan AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 WHERE {_D2} <= 1"""


def _shift_sql(mass: str) -> str:
    return f"""
SELECT scan, pid, round(coalesce(sum(k * n_y) / nullif(sum(k), 0) - c_y, 0) + 1e-9, 6) AS s_y, round(coalesce(sum(k * n_x) / nullif(sum(k), 0) - c_x, 0) + 1e-9, 6) AS s_x,
       round(coalesce(sum(k * n_v) / nullif(sum(k), 0) - v, 0) + 1e-9, 6) AS s_v, round(coalesce(sum(k * n_u) / nullif(sum(k), 0) - u, 0) + 1e-9, 6) AS s_u
FROM (SELECT *, {mass} AS k FROM raw_near) GROUP BY scan, pid, c_y, c_x, v, u"""


def _shift(w, kernel, size, weight, points=None):
    out = meanshift.shift_vectors(
        w.weighted if points is None else points, tb.GRID, ["v", "u"], tb.DETECTION.ranges, kernel, size, weight, normalise=False)
    return out.select("scan", "pid", up("s_y", "s_y"), up("s_x", "s_x"), up("s_v", "s_v"), up("s_u", "s_u"))


@query("ms_vector", _shift_sql("exp(-5e-1 * d2) * 5e-1 * n_w"))
def ms_vector(w):
    return _shift(w, kernels.gauss, 1.0, "w")


@query("ms_vector_epanechnikov", _shift_sql("CASE WHEN d2 <= 1 THEN 1e0 - d2 ELSE 0e0 END"))
def ms_vector_epanechnikov(w):
    return _shift(w, kernels.epanechnikov, 1.0, None)


@query("k_none", _shift_sql("n_w"))
def k_none(w):
    return _shift(w, None, 1.0, "w")


@query("ms_vector_plain", _shift_sql("1e0"))
def ms_vector_plain(w):
    return _shift(w, kernels.uniform, 1.0, None)


@query("ms_gridded_shift", "SELECT scan, gid, g_y, g_x, zero_shift FROM shifts")
def ms_gridded_shift(w):
    return w.shifts.select("scan", "gid", "g_y", "g_x", "zero_shift")


@query("ms_vector_3d", """
SELECT scan, pid, round(sum(k * n_z) / sum(k) - z, 6) AS s_z, round(sum(k * n_y) / sum(k) - y, 6) AS s_y, round(sum(k * n_x) / sum(k) - x, 6) AS s_x
FROM (SELECT a.scan, a.z, a.y, a.x, CAST(a.z * 675 + a.y * 27 + a.x AS BIGINT) AS pid, b.z AS n_z, b.y AS n_y, b.x AS n_x,
             exp(-5e-1 * (((a.z-b.z)/2e0)*((a.z-b.z)/2e0) + ((a.y-b.y)/2e0)*((a.y-b.y)/2e0) + ((a.x-b.x)/2e0)*((a.x-b.x)/2e0))) * 5e-1 AS k,
             ((a.z-b.z)/2e0)*((a.z-b.z)/2e0) + ((a.y-b.y)/2e0)*((a.y-b.y)/2e0) + ((a.x-b.x)/2e0)*((a.x-b.x)/2e0) AS d2
      FROM cells_3d a JOIN cells_3d b ON b.scan = a.scan AND abs(a.z-b.z) <= 2 AND abs(a.y-b.y) <= 2 AND abs(a.x-b.x) <= 2) WHERE d2 <= 1
GROUP BY scan, pid, z, y, x""")
def ms_vector_3d(w):
    from skytrace.operators import featurespace

    points = featurespace.build(tb.cells_3d(w.spark, w.sf_dir), tb.GRID_3D, [tb.V])
    out = meanshift.shift_vectors(points, tb.GRID_3D, [], (2.0, 2.0, 2.0), kernels.gauss, 1.0, None, normalise=False)
    return out.select("scan", "pid", r("s_z", "s_z"), r("s_y", "s_y"), r("s_x", "s_x"))


CTES["cells_3d"] = """
SELECT DISTINCT scan, z, y, x FROM (
SELECT l_suppkey AS scan, CAST(l_linenumber - 1 AS INTEGER) AS z, CAST(floor((l_quantity - 1) / 2) AS INTEGER) AS y,
       CAST(floor((dayofyear(l_shipdate) - 1) / 14e0) AS INTEGER) AS x, max(l_tax) AS tax FROM lineitem GROUP BY 1, 2, 3, 4) WHERE tax < 8e-2"""


def trajectories(w):
    """From every cluster centre: how far the mode climbs."""
    if not hasattr(w, "_trajectories"):
        seeds = w.detection.clusters.select("scan", F.col("cluster").alias("seed"), F.col("center_y").alias("c_y"), F.col("center_x").alias("c_x"))
        w._trajectories = meanshift.iterate(seeds, w.weighted, tb.GRID, [], (2.0, 2.0), kernels.gauss, 1.0, "w")
    return w._trajectories


CTES["walk"] = """RECURSIVE (scan, seed, step, c_y, c_x, norm) ::
SELECT scan, cluster, 0, center_y, center_x, CAST(NULL AS DOUBLE) FROM clusters
UNION ALL
SELECT scan, seed, step + 1, my, mx, sqrt((my - c_y) * (my - c_y) + (mx - c_x) * (mx - c_x)) FROM (
  SELECT scan, seed, step, c_y, c_x, sum(k * py) / sum(k) AS my, sum(k * px) / sum(k) AS mx FROM (
    SELECT t.scan, t.seed, t.step, t.c_y, t.c_x, p.c_y AS py, p.c_x AS px, p.w AS pw,
           ((t.c_y-p.c_y)/2e0)*((t.c_y-p.c_y)/2e0) + ((t.c_x-p.c_x)/2e0)*((t.c_x-p.c_x)/2e0) AS d2, exp(-5e-1 *
           (((t.c_y-p.c_y)/2e0)*((t.c_y-p.c_y)/2e0) + ((t.c_x-p.c_x)/2e0)*((t.c_x-p.c_x)/2e0))) * 5e-1 * p.w AS k
    FROM walk t JOIN weighted p ON p.scan = t.scan AND abs(p.c_y - t.c_y) <= 2 AND abs(p.c_x - t.c_x) <= 2
    WHERE (t.norm IS NULL OR t.norm >= 1e-2) AND t.step < 1000) WHERE d2 <= 1 GROUP BY ALL)"""


@query("ms_trajectory", "SELECT scan, seed, step, round(c_y, 4) AS c_y, round(c_x, 4) AS c_x FROM walk")
def ms_trajectory(w):
    return trajectories(w).select("scan", "seed", "step", r("c_y", "c_y", 4), r("c_x", "c_x", 4))


@query("ms_iterate", """
SELECT w.scan, w.seed, w.step AS steps, round(w.c_y, 4) AS c_y, round(w.c_x, 4) AS c_x FROM walk w
JOIN (SELECT seed, max(step) AS step FROM walk GROUP BY seed) l ON l.seed = w.seed AND l.step = w.step""")
def ms_iterate(w):
    return meanshift.iterate_end(trajectories(w)).select("scan", "seed", "steps", r("c_y", "c_y", 4), r("c_x", "c_x", 4))


@query("ms_cluster_op", "SELECT scan, cluster, detection_id, size, round(mode_v, 6) AS mode_v, round(mode_u, 6) AS mode_u, has_margin FROM clusters")
def ms_cluster_op(w):
    return w.detection.clusters.select("scan", "cluster", "detection_id", "size", r("mode_v", "mode_v"), r("mode_u", "mode_u"), "has_margin")
