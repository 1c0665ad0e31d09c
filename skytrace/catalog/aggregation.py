"""Per-cluster aggregates, histograms and rank correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytrace.catalog.base import CTES, query
from skytrace.catalog.scans import r, up
from skytrace.operators import aggregates, clustering
from skytrace.sources import tables as tb


@query("agg_size", "SELECT scan, cluster, size FROM clusters")
def agg_size(w):
    return clustering.sizes(w.detection.members)


def _summary(w):
    return aggregates.summarise(w.detection.members, tb.GRID, ["v", "u"])


@query("agg_mode", "SELECT cluster, round(center_y, 6) AS mode_y, round(center_x, 6) AS mode_x, round(mode_v, 6) AS mode_v, round(mode_u, 6) AS mode_u FROM clusters")
def agg_mode(w):
    return _summary(w).select("cluster", r("center_y", "mode_y"), r("center_x", "mode_x"), r("mode_v", "mode_v"), r("mode_u", "mode_u"))


@query("agg_center", "SELECT cluster, round(center_y, 6) AS center_y, round(center_x, 6) AS center_x FROM clusters")
def agg_center(w):
    return _summary(w).select("cluster", r("center_y", "center_y"), r("center_x", "center_x"))


def _weighed_sql(mass: str) -> str:
    return f"""
SELECT cluster, round(sum(c_y * q) / sum(q) + 1e-9, 6) AS center_y, round(sum(c_x * q) / sum(q) + 1e-9, 6) AS center_x FROM (
  SELECT m.cluster, c_y, c_x, CASE WHEN c.max_v = c.min_v THEN 1e0 ELSE {mass} / (c.max_v - c.min_v) END AS q
  FROM members m JOIN clusters c ON c.cluster = m.cluster) GROUP BY cluster"""


@query("agg_weighed_center", _weighed_sql("(v - c.min_v)"))
def agg_weighed_center(w):
    out = aggregates.weighed_center(w.detection.members, tb.GRID, "v")
    return out.select("cluster", up("center_y", "center_y"), up("center_x", "center_x"))


@query("agg_weighed_center_inverted", _weighed_sql("(c.max_v - v)"))
def agg_weighed_center_inverted(w):
    out = aggregates.weighed_center(w.detection.members, tb.GRID, "v", inverted=True)
    return out.select("cluster", up("center_y", "center_y"), up("center_x", "center_x"))


@query("agg_bbox", "SELECT cluster, bbox_min_y, bbox_max_y, bbox_min_x, bbox_max_x FROM clusters")
def agg_bbox(w):
    return _summary(w).select("cluster", "bbox_min_y", "bbox_max_y", "bbox_min_x", "bbox_max_x")


@query("agg_radius", "SELECT scan, cluster, round(radius_m, 6) AS radius_m FROM clusters")
def agg_radius(w):
    out = aggregates.radius(w.detection.members, w.detection.clusters, tb.GRID)
    return out.select("scan", "cluster", r("radius_m", "radius_m"))


@query("agg_var_ranges", """
SELECT c.cluster, c.min_v, c.max_v, m.median_v, c.min_u, c.max_u, m.median_u FROM clusters c JOIN medians m ON m.cluster = c.cluster""")
def agg_var_ranges(w):
    return _summary(w).select("cluster", "min_v", "max_v", "min_u", "max_u").join(w.medians, "cluster")


@query("agg_median_binned", "SELECT cluster, median_v AS v, median_u AS u FROM medians")
def agg_median_binned(w):
    """The plan for clusters too large for one median state."""
    return aggregates.value_medians(w.detection.members, ["v", "u"])


CTES["hist"] = """
SELECT scan, cluster, CAST(CASE WHEN v >= 30 THEN 24 ELSE least(floor(v / (30e0 / 25)), 24) END AS INTEGER) AS bin, count(*) AS n FROM members WHERE v >= 0 GROUP BY ALL"""


@query("agg_histogram", "SELECT scan, cluster, bin, n FROM hist")
def agg_histogram(w):
    return aggregates.histograms(w.detection.members, "v", 0.0, 30.0)


@query("agg_hist_sum", "SELECT cluster, CAST(sum(n) AS BIGINT) AS total FROM hist GROUP BY cluster")
def agg_hist_sum(w):
    return aggregates.histograms(w.detection.members, "v", 0.0, 30.0).groupBy("cluster").agg(F.sum("n").alias("total"))


CTES["hist_pairs"] = """
SELECT s.n, s.m, b.i, coalesce(hn.n, 0) AS a, coalesce(hm.n, 0) AS b FROM shared_cells s CROSS JOIN (SELECT CAST(i AS INTEGER) AS i FROM range(0, 25) t(i)) b
LEFT JOIN hist hn ON hn.cluster = s.n AND hn.bin = b.i LEFT JOIN hist hm ON hm.cluster = s.m AND hm.bin = b.i"""


def _hist_pairs(w):
    hist = aggregates.histogram_arrays(w.detection.members, "v", 0.0, 30.0).select("cluster", "hist")
    overlapping = w.tracks.scored.where("shared > 0").select("n", "m")
    return overlapping.join(hist.select(F.col("cluster").alias("n"), F.col("hist").alias("a")), "n").join(
        hist.select(F.col("cluster").alias("m"), F.col("hist").alias("b")), "m")


@query("agg_kendall", """
SELECT p.n, p.m, round(coalesce(sum(sign(p.a - q.a) * sign(p.b - q.b)) / nullif(sqrt(CAST(sum(abs(sign(p.a - q.a))) AS DOUBLE)) * sqrt(CAST(sum(abs(sign(p.b - q.b))) AS DOUBLE)), 0), -1), 6) AS tau
FROM hist_pairs p JOIN hist_pairs q ON q.n = p.n AND q.m = p.m AND p.i < q.i GROUP BY p.n, p.m""")
def agg_kendall(w):
    return _hist_pairs(w).select("n", "m", r(aggregates.kendall(F.col("a"), F.col("b")), "tau"))


@query("agg_spearman", """
SELECT n, m, round(coalesce(sum((ra - 13e0) * (rb - 13e0)) / nullif(sqrt(sum((ra - 13e0) * (ra - 13e0))) * sqrt(sum((rb - 13e0) * (rb - 13e0))), 0), -1), 6) AS rho
FROM (SELECT n, m, rank() OVER (PARTITION BY n, m ORDER BY a) + (count(*) OVER (PARTITION BY n, m, a) - 1) / 2e0 AS ra,
             rank() OVER (PARTITION BY n, m ORDER BY b) + (count(*) OVER (PARTITION BY n, m, b) - 1) / 2e0 AS rb FROM hist_pairs) GROUP BY n, m""")
def agg_spearman(w):
    return _hist_pairs(w).select("n", "m", r(aggregates.spearman(F.col("a"), F.col("b")), "rho"))


_WEIGHTS = "SELECT cluster, round(min(w), 6) AS w_min, round(max(w), 6) AS w_max, round(sum(w) + 1e-9, 6) AS w_sum, round(avg(w) + 1e-9, 6) AS w_mean FROM members GROUP BY cluster"


@query("agg_dynamic_range", f"SELECT cluster, w_min, w_max FROM ({_WEIGHTS})")
def agg_dynamic_range(w):
    return aggregates.weight_statistics(w.detection.members).select("cluster", r("w_min", "w_min"), r("w_max", "w_max"))


@query("agg_avg_weight", f"SELECT cluster, w_sum, w_mean FROM ({_WEIGHTS})")
def agg_avg_weight(w):
    return aggregates.weight_statistics(w.detection.members).select("cluster", up("w_sum", "w_sum"), up("w_mean", "w_mean"))


CTES["modal"] = """
SELECT c.scan, c.cluster, coalesce(p.w, 0) AS modal_weight FROM clusters c LEFT JOIN weighted p
ON p.scan = c.scan AND p.y = CAST(round(c.center_y) AS INTEGER) AND p.x = CAST(round(c.center_x) AS INTEGER)"""


@query("agg_modal_weight", "SELECT scan, cluster, round(modal_weight, 6) AS modal_weight FROM modal")
def agg_modal_weight(w):
    out = aggregates.modal_weight(w.detection.clusters, w.weighted, tb.GRID)
    return out.withColumn("modal_weight", F.round("modal_weight", 6))


@query("agg_modal_sort", "SELECT scan, cluster, row_number() OVER (PARTITION BY scan ORDER BY round(modal_weight, 6) DESC, cluster) AS position FROM modal")
def agg_modal_sort(w):
    out = aggregates.modal_weight(w.detection.clusters, w.weighted, tb.GRID)
    return aggregates.rank_within(out.withColumn("modal_weight", F.round("modal_weight", 6)), "scan", "modal_weight", "cluster", "position")


@query("agg_count_value", "SELECT scan, count(*) FILTER (WHERE v_raw = 255) AS n FROM cells GROUP BY scan")
def agg_count_value(w):
    return aggregates.count_value(w.cells, "v_raw", 255, ["scan"])
