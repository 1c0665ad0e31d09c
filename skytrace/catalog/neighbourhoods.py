"""Stencil filters and range searches."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skytrace.catalog.base import CTES, query, smooth_pass
from skytrace.catalog.scans import r
from skytrace.operators import featurespace, filters, metric, tracking
from skytrace.operators.neighbours import box_pairs, ellipsoid_pairs, moore_pairs, near_pairs, nearest
from skytrace.params import DECAY
from skytrace.sources import tables as tb

SCALE = 4.0
_TAPS = filters.smoothing_taps(SCALE, 1.0)
CTES["smooth_0"] = "SELECT scan, y, x, v, u, true AS original FROM points"
CTES["smooth_y"] = smooth_pass("smooth_0", ["v", "u"], "y", "x", 25, _TAPS)
CTES["smooth_yx"] = smooth_pass("smooth_y", ["v", "u"], "x", "y", 27, _TAPS)
CTES["smooth_cy"] = smooth_pass("smooth_0", ["v", "u"], "y", "x", 25, _TAPS, symmetric=False)
CTES["smooth_cyx"] = smooth_pass("smooth_cy", ["v", "u"], "x", "y", 27, _TAPS, symmetric=False)


@query("flt_scale_space", """
SELECT scan, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(v, 6) AS v, round(u, 6) AS u, original AS is_original FROM smooth_yx""")
def flt_scale_space(w):
    out = filters.scale_space(w.points, tb.GRID, ["v", "u"], SCALE)
    return out.select("scan", "y", "x", r("v", "v"), r("u", "u"), "is_original")


@query("flt_scale_space_compat", """
SELECT scan, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(v, 6) AS v, round(u, 6) AS u, original AS is_original FROM smooth_cyx""")
def flt_scale_space_compat(w):
    out = filters.scale_space(w.points, tb.GRID, ["v", "u"], SCALE, symmetric=False)
    return out.select("scan", "y", "x", r("v", "v"), r("u", "u"), "is_original")


@query("flt_scale_to_width", f"SELECT scan, pid, round(sqrt(ceil(-2e0 * v * {math.log(DECAY)!r})) / 2e0, 6) AS width FROM points")
def flt_scale_to_width(w):
    return w.points.select("scan", "pid", r(F.sqrt(F.ceil(F.col("v") * (-2.0 * math.log(DECAY)))) / 2.0, "width"))


@query("flt_width_to_scale", f"SELECT scan, pid, round(-2e0 * v * v / {math.log(DECAY)!r}, 6) AS scale FROM points")
def flt_width_to_scale(w):
    return w.points.select("scan", "pid", r(F.col("v") * F.col("v") * -2.0 / math.log(DECAY), "scale"))


@query("flt_range_factors", """
SELECT b.scan, round((a.vs) / b.vs, 6) AS v_factor, round((a.us) / b.us, 6) AS u_factor
FROM (SELECT scan, max(v) - min(v) AS vs, max(u) - min(u) AS us FROM points GROUP BY scan) b
JOIN (SELECT scan, max(v) - min(v) AS vs, max(u) - min(u) AS us FROM smooth_yx GROUP BY scan) a ON a.scan = b.scan""")
def flt_range_factors(w):
    after = filters.scale_space(w.points, tb.GRID, ["v", "u"], SCALE)
    out = filters.range_factors(w.points, after, ["v", "u"])
    return out.select("scan", r("v_factor", "v_factor"), r("u_factor", "u_factor"))


@query("flt_original", "SELECT scan, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM smooth_yx WHERE original")
def flt_original(w):
    return filters.scale_space(w.points, tb.GRID, ["v", "u"], SCALE).where("is_original").select("scan", "y", "x")


@query("fs_count_original", "SELECT scan, count(*) FILTER (WHERE original) AS n_original, count(*) AS n_points FROM smooth_yx GROUP BY scan")
def fs_count_original(w):
    return featurespace.count_original(filters.scale_space(w.points, tb.GRID, ["v", "u"], SCALE))


_RANGES = (2.0, 2.0, 10.0, 50.0)
_D2 = "((a.c_y-b.c_y)/2e0)*((a.c_y-b.c_y)/2e0) + ((a.c_x-b.c_x)/2e0)*((a.c_x-b.c_x)/2e0) + ((a.v-b.v)/10e0)*((a.v-b.v)/10e0) + ((a.u-b.u)/50e0)*((a.u-b.u)/50e0)"
CTES["near"] = f"""
SELECT a.scan, a.pid, b.pid AS n_pid, b.v AS n_v, {_D2} AS d2 FROM points a JOIN points b
ON a.scan = b.scan AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 WHERE {_D2} <= 1
"""


def _replacement_sql(order: str, fraction: str) -> str:
    return f"""
SELECT scan, pid, round(avg(n_v), 6) AS v FROM (
  SELECT scan, pid, n_v, row_number() OVER (PARTITION BY scan, pid ORDER BY n_v {order}) AS rn, count(*) OVER (PARTITION BY scan, pid) AS n FROM near)
WHERE rn <= greatest(round(n * {fraction}), 1) GROUP BY scan, pid"""


def _replace(w, mode: str, fraction: float):
    out = filters.replacement(w.points, tb.GRID, "v", mode, fraction, _RANGES, ["c_y", "c_x", "v", "u"])
    return out.select("scan", "pid", r("v", "v"))


@query("flt_replacement_lowest", _replacement_sql("", "5e-1"))
def flt_replacement_lowest(w):
    return _replace(w, "lowest", 0.5)


@query("flt_replacement_highest", _replacement_sql("DESC", "5e-1"))
def flt_replacement_highest(w):
    return _replace(w, "highest", 0.5)


@query("flt_replacement_median", """
SELECT scan, pid, max(n_v) AS v FROM (
  SELECT scan, pid, n_v, row_number() OVER (PARTITION BY scan, pid ORDER BY n_v) AS rn, count(*) OVER (PARTITION BY scan, pid) AS n FROM near)
WHERE rn = n // 2 + 1 GROUP BY scan, pid""")
def flt_replacement_median(w):
    out = filters.replacement(w.points, tb.GRID, "v", "median", 1.0, _RANGES, ["c_y", "c_x", "v", "u"])
    return out.select("scan", "pid", "v")


CTES["storm"] = "SELECT scan, pid, y, x, v * 2e0 AS z FROM points"
CTES["storm_near"] = """
SELECT a.scan, a.pid, a.y, a.x, a.z, avg(b.z) AS bg FROM storm a JOIN storm b
ON a.scan = b.scan AND abs(a.y-b.y) <= 3 AND abs(a.x-b.x) <= 3 AND (a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x) <= 9 GROUP BY ALL"""


@query("flt_convection", """
SELECT DISTINCT p.scan, p.pid, p.z FROM storm p JOIN storm_near c ON c.scan = p.scan AND (c.y-p.y)*(c.y-p.y) + (c.x-p.x)*(c.x-p.x) <= 1
WHERE c.z >= 40 OR c.z - c.bg >= CASE WHEN c.bg BETWEEN 0 AND 40 THEN 10e0 - c.bg * c.bg / 180e0 ELSE 10e0 END""")
def flt_convection(w):
    storm = w.points.withColumn("z", F.col("v") * 2.0)
    out = filters.convection(storm, tb.GRID, "z", (3.0, 3.0), published_criterion=True, radius_factor=0.4)
    return out.select("scan", "pid", "z")


@query("flt_convection_zeroed", """
SELECT p.scan, p.pid, CASE WHEN max(CASE WHEN c.z >= 40 OR CASE WHEN c.bg BETWEEN 0 AND 40 THEN 10e0 - c.bg * c.bg / 180e0 ELSE 10e0 END > 45e-1
       THEN 1 ELSE 0 END) = 1 THEN p.z ELSE 0e0 END AS z
FROM storm p JOIN storm_near c ON c.scan = p.scan AND (c.y-p.y)*(c.y-p.y) + (c.x-p.x)*(c.x-p.x) <= 1 GROUP BY p.scan, p.pid, p.z""")
def flt_convection_zeroed(w):
    storm = w.points.withColumn("z", F.col("v") * 2.0)
    return filters.convection(storm, tb.GRID, "z", (3.0, 3.0), erase=False, radius_factor=0.4).select("scan", "pid", "z")


_BOX = "cells a JOIN cells b ON b.scan = a.scan AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2"


@query("flt_coldest_quartile", f"""
SELECT scan, y, x, round(avg(n_u), 6) AS u_raw FROM (
  SELECT a.scan, a.y, a.x, b.u_raw AS n_u, row_number() OVER (PARTITION BY a.scan, a.y, a.x ORDER BY b.u_raw) AS rn,
         count(*) OVER (PARTITION BY a.scan, a.y, a.x) AS n FROM {_BOX}) WHERE rn <= round(n * 25e-2) GROUP BY ALL
UNION ALL SELECT a.scan, a.y, a.x, CAST(NULL AS DOUBLE) FROM {_BOX} GROUP BY ALL HAVING round(count(*) * 25e-2) = 0""")
def flt_coldest_quartile(w):
    out = filters.coldest_share(w.cells, tb.GRID, "u_raw", {"y": 2, "x": 2})
    return out.select("scan", "y", "x", r("u_raw", "u_raw"))


@query("nbr_moore", """
SELECT a.scan, a.pid, count(*) AS neighbours, sum(b.v) AS v_sum FROM points a JOIN points b
ON a.scan = b.scan AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL""")
def nbr_moore(w):
    p = w.points.select("scan", "pid", "y", "x", "v")
    return moore_pairs(p, p, tb.GRID.dims).groupBy("scan", "_b_y", "_b_x", "pid").agg(
        F.count("*").alias("neighbours"), F.sum("n_v").alias("v_sum")).drop("_b_y", "_b_x")


@query("nbr_box_values", f"""
SELECT a.scan, a.y, a.x, count(*) AS n, min(b.u_raw) AS lowest, max(b.u_raw) AS highest FROM {_BOX} GROUP BY ALL""")
def nbr_box_values(w):
    out = filters.box_values(w.cells, tb.GRID, "u_raw", {"y": 2, "x": 2})
    return out.select("scan", "y", "x", F.size("box").cast("bigint").alias("n"), F.array_min("box").alias("lowest"), F.array_max("box").alias("highest"))


def _ellipsoid(w):
    p = w.points.select("scan", "pid", "y", "x", "c_y", "c_x", "v", "u")
    return ellipsoid_pairs(p, p, tb.GRID.reach((2.0, 2.0)), ["c_y", "c_x", "v", "u"], list(_RANGES))


_ELLIPSOID_SQL = "SELECT scan, pid, n_pid, round(d2, 6) AS d2 FROM near"


@query("join_range_ellipsoid", _ELLIPSOID_SQL)
def join_range_ellipsoid(w):
    return _ellipsoid(w).select("scan", "pid", "n_pid", r("d2", "d2"))


@query("join_range_kdtree", "SELECT scan, pid, count(*) AS hits, round(max(d2), 6) AS farthest FROM near GROUP BY scan, pid")
def join_range_kdtree(w):
    return _ellipsoid(w).groupBy("scan", "_b_y", "_b_x", "pid").agg(
        F.count("*").alias("hits"), r(F.max("d2"), "farthest")).drop("_b_y", "_b_x")


@query("join_range_linear", "SELECT scan, pid, n_pid FROM near WHERE n_pid <> pid")
def join_range_linear(w):
    return _ellipsoid(w).where("n_pid <> pid").select("scan", "pid", "n_pid")


@query("join_range_rectilinear", """
SELECT a.scan, a.pid, b.pid AS n_pid FROM points a JOIN points b ON a.scan = b.scan AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2
AND abs(a.v - b.v) <= 10 AND abs(a.u - b.u) <= 50""")
def join_range_rectilinear(w):
    p = w.points.select("scan", "pid", "y", "x", "v", "u")
    return box_pairs(p, p, {"y": 2, "x": 2}, {"v": 10.0, "u": 50.0}).select("scan", "pid", "n_pid")


@query("join_knn", """
SELECT scan, gid, CAST(rank AS INTEGER) AS rank, n_gid, round(sqrt(d2), 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY gid ORDER BY d2, n_gid) AS rank FROM (
    SELECT a.scan, a.gid, b.gid AS n_gid, (CAST(a.y-b.y AS DOUBLE)/1e0)*(CAST(a.y-b.y AS DOUBLE)/1e0) + ((a.x-b.x)/1e0)*((a.x-b.x)/1e0) AS d2
    FROM points a JOIN points b ON a.scan = b.scan)) WHERE rank <= 5""")
def join_knn(w):
    p = w.points.select("scan", "gid", "c_y", "c_x")
    out = nearest(p, p, 5, ["c_y", "c_x"], [1.0, 1.0], "gid", "gid", ("scan",), start=2.0)
    return out.withColumn("distance", F.round("distance", 6))


@query("join_has_point", """
SELECT scan, y, x, EXISTS (SELECT 1 FROM points p WHERE p.scan = c.scan AND p.y = c.y AND p.x = c.x) AS has_point FROM cells c""")
def join_has_point(w):
    known = w.points.select("scan", "y", "x", F.lit(True).alias("has_point"))
    return w.cells.select("scan", "y", "x").join(known, ["scan", "y", "x"], "left").withColumn("has_point", F.coalesce("has_point", F.lit(False)))


@query("join_index_maintenance", """
SELECT scan, y, x FROM points WHERE v < 5 UNION SELECT scan, y, x FROM cells WHERE v_raw = 255
EXCEPT SELECT scan, y, x FROM points WHERE u >= 90""")
def join_index_maintenance(w):
    index = w.points.where("v < 5").select("scan", "y", "x")
    added = index.unionByName(w.cells.where("v_raw = 255").select("scan", "y", "x")).dropDuplicates()
    return added.join(w.points.where("u >= 90").select("scan", "y", "x"), ["scan", "y", "x"], "left_anti")


@query("join_shift_target", "SELECT scan, src, dst FROM move_edges")
def join_shift_target(w):
    from skytrace.operators import clustering

    return clustering.shift_edges(w.shifts, tb.GRID).select("scan", "src", "dst")


@query("join_cell_cover", "SELECT pair, n, m, shared FROM shared_cells")
def join_cell_cover(w):
    return tracking.covers(w.detection.members, w.tracks.pairs)


@query("join_cluster_pairs", "SELECT pair, n, m FROM all_pairs WHERE dr_m <= 50e0 * dt OR shared > 0")
def join_cluster_pairs(w):
    return w.tracks.scored.where(tracking.velocity_ok(tb.TRACKING) | (F.col("shared") > 0)).select("pair", "n", "m")


@query("join_new_ids", "SELECT scan, cluster FROM clusters WHERE cluster NOT IN (SELECT n FROM matches)")
def join_new_ids(w):
    return w.detection.clusters.select("scan", "cluster").join(w.tracks.matches.select(F.col("n").alias("cluster")), "cluster", "left_anti").select("scan", "cluster")


@query("join_dropped_ids", """
SELECT l.scan AS pair, c.cluster AS m FROM clusters c JOIN pairs l ON l.prev_scan = c.scan AND l.linked WHERE c.cluster NOT IN (SELECT m FROM matches)""")
def join_dropped_ids(w):
    return tracking.dropped(w.detection.clusters, w.tracks.matches, w.tracks.pairs)


@query("join_consecutive", "SELECT scan, ts, step, prev_scan, dt, linked FROM pairs")
def join_consecutive(w):
    return tracking.scan_pairs(w.scans, tb.TRACKING)


@query("join_tracks_links", """
SELECT a.uuid AS source, b.uuid AS target, a.id FROM nodes a JOIN nodes b ON b.id = a.id AND b.step = a.step + 1""")
def join_tracks_links(w):
    nodes, _ = w.graph
    before = nodes.select("id", F.col("uuid").alias("source"), (F.col("step") + 1).alias("step"))
    return before.join(nodes.select("id", "step", F.col("uuid").alias("target")), ["id", "step"]).select("source", "target", "id")


# all 64 components of the embeddings are measured, in one group per label
VECTOR = [f"e{i}" for i in range(64)]
KD_BANDWIDTH = 0.8
CTES["vectors"] = "SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate(VECTOR)) + " FROM embeddings"
CTES["vector_pairs"] = ("SELECT p.label, p.vec_id, q.vec_id AS n_vec_id, " + " + ".join(f"((p.{n}-q.{n})/8e-1)*((p.{n}-q.{n})/8e-1)" for n in VECTOR)
                        + " AS d2 FROM vectors p JOIN vectors q ON q.label = p.label")


def _vectors(w):
    parts = [F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(VECTOR)]
    return w.table("embeddings").select("vec_id", "label", *parts)


def _kd(w, k: int):
    v = _vectors(w)
    out = metric.nearest(v, v, k, VECTOR, [KD_BANDWIDTH] * len(VECTOR), "vec_id", "vec_id", ("label",))
    return out.withColumn("distance", F.round("distance", 6))


_KD_SQL = """
SELECT label, vec_id, CAST(rank AS INTEGER) AS rank, n_vec_id, round(sqrt(d2), 6) AS distance FROM (
SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, n_vec_id) AS rank FROM vector_pairs) WHERE rank <= %d"""


@query("join_kd_nearest", _KD_SQL % 1)
def join_kd_nearest(w):
    return _kd(w, 1)


@query("join_kd_nearest_n", _KD_SQL % 6)
def join_kd_nearest_n(w):
    return _kd(w, 6)


@query("join_kd_range", "SELECT label, vec_id, n_vec_id, round(d2, 6) AS d2 FROM vector_pairs WHERE d2 <= 1")
def join_kd_range(w):
    v = _vectors(w)
    out = metric.within(v, v, 1.0, VECTOR, [KD_BANDWIDTH] * len(VECTOR), "vec_id", "vec_id", ("label",))
    return out.select("label", "vec_id", "n_vec_id", r("d2", "d2"))
