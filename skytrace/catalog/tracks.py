"""Tracking operators."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import functions as F

from skytrace.catalog.base import CTES, detection_chain, query
from skytrace.catalog.features import _B, _bt
from skytrace.catalog.scans import r
from skytrace.operators import aggregates, featurespace, tracking
from skytrace.operators.filters import smoothing_taps
from skytrace.params import scale_to_filter_width
from skytrace.plans.satellite import freezing_radiance
from skytrace.session import cut
from skytrace.sources import tables as tb


@query("trk_pair_gate", "SELECT scan, prev_scan, dt, linked FROM pairs")
def trk_pair_gate(w):
    return w.tracks.pairs.select("scan", "prev_scan", "dt", "linked")


@query("trk_cover", "SELECT n, m, shared, round(cover_old_by_new, 6) AS cover_old_by_new, round(cover_new_by_old, 6) AS cover_new_by_old FROM all_pairs WHERE shared > 0")
def trk_cover(w):
    return w.tracks.scored.where("shared > 0").select("n", "m", "shared", r("cover_old_by_new", "cover_old_by_new"), r("cover_new_by_old", "cover_new_by_old"))


@query("trk_displacement", "SELECT n, m, round(dr_m, 6) AS dr_m FROM all_pairs WHERE shared > 0 OR dr_m <= 50e0 * dt")
def trk_displacement(w):
    return w.tracks.scored.where(tracking.velocity_ok(tb.TRACKING) | (F.col("shared") > 0)).select("n", "m", r("dr_m", "dr_m"))


def _constraint(w, test):
    kept = w.tracks.scored.where(tracking.velocity_ok(tb.TRACKING) | (F.col("shared") > 0))
    return kept.select("n", "m", test.alias("passes"))


_CANDIDATES = "FROM flagged WHERE shared > 0 OR velocity_ok"


@query("trk_overlap_constraint", f"SELECT n, m, overlap_ok AS passes {_CANDIDATES}")
def trk_overlap_constraint(w):
    return _constraint(w, tracking.overlap_ok(tb.TRACKING))


@query("trk_size_constraint", f"SELECT n, m, size_ok AS passes {_CANDIDATES}")
def trk_size_constraint(w):
    return _constraint(w, tracking.size_ok(tb.TRACKING))


@query("trk_velocity_constraint", f"SELECT n, m, velocity_ok AS passes {_CANDIDATES}")
def trk_velocity_constraint(w):
    return _constraint(w, tracking.velocity_ok(tb.TRACKING))


@query("trk_maxima", "SELECT pair, round(max_dr, 6) AS max_dr, max_dh FROM maxima WHERE pair IN (SELECT pair FROM scored)")
def trk_maxima(w):
    t, d = w.tracks, w.detection
    out = tracking.pair_maxima(t.scored, d.clusters, t.pairs, tb.GRID, tb.TRACKING)
    kept = out.join(t.scored.where("possible OR shared > 0").select("pair").distinct(), "pair", "left_semi")
    return kept.select("pair", r("max_dr", "max_dr"), "max_dh")


@query("trk_likelihood", "SELECT n, m, round(likelihood, 6) AS likelihood FROM scored WHERE possible")
def trk_likelihood(w):
    return w.tracks.scored.where("possible").select("n", "m", r("likelihood", "likelihood"))


_FULL = replace(tb.TRACKING, tracking_variable="v", correlation_weight=1.0)
CTES["taus"] = """
SELECT p.n, p.m, coalesce(sum(sign(p.a - q.a) * sign(p.b - q.b)) / nullif(sqrt(CAST(sum(abs(sign(p.a - q.a))) AS DOUBLE)) * sqrt(CAST(sum(abs(sign(p.b - q.b))) AS DOUBLE)), 0), -1) AS tau
FROM (SELECT s.n, s.m, b.i, coalesce(hn.n, 0) AS a, coalesce(hm.n, 0) AS b FROM (SELECT n, m FROM scored WHERE possible) s
      CROSS JOIN (SELECT CAST(i AS INTEGER) AS i FROM range(0, 25) t(i)) b
      LEFT JOIN hist hn ON hn.cluster = s.n AND hn.bin = b.i LEFT JOIN hist hm ON hm.cluster = s.m AND hm.bin = b.i) p
JOIN (SELECT s.n, s.m, b.i, coalesce(hn.n, 0) AS a, coalesce(hm.n, 0) AS b FROM (SELECT n, m FROM scored WHERE possible) s
      CROSS JOIN (SELECT CAST(i AS INTEGER) AS i FROM range(0, 25) t(i)) b
      LEFT JOIN hist hn ON hn.cluster = s.n AND hn.bin = b.i LEFT JOIN hist hm ON hm.cluster = s.m AND hm.bin = b.i) q
ON q.n = p.n AND q.m = p.m AND p.i < q.i GROUP BY p.n, p.m"""


def _full_sql() -> str:
    from skytrace.catalog.base import _ALIKE, _NEAR

    near = _NEAR.replace("x.max_dr", "f.max_dr")
    alike = _ALIKE.replace("x.max_dh", "f.max_dh")
    return f"SELECT f.n, f.m, round({near} + {alike} + t.tau, 6) AS likelihood FROM scored f JOIN taus t ON t.n = f.n AND t.m = f.m WHERE f.possible"


@query("trk_likelihood_full", _full_sql())
def trk_likelihood_full(w):
    """All three terms: position, size and histogram correlation."""
    t, d = w.tracks, w.detection
    hist = aggregates.histogram_arrays(d.members, "v", *tb.LIMITS["v"]).select("cluster", "hist")
    base = cut(d.clusters.join(hist, "cluster"))
    candidates = cut(tracking.candidate_pairs(base, d.members, t.pairs, tb.GRID, _FULL))
    maxima = tracking.pair_maxima(candidates, base, t.pairs, tb.GRID, _FULL)
    return tracking.score(candidates, maxima, t.pairs, _FULL).where("possible").select("n", "m", r("likelihood", "likelihood"))


@query("trk_match", "SELECT pair, n, m, round(dr_m, 6) AS dr_m FROM matches")
def trk_match(w):
    return w.tracks.matches.select("pair", "n", "m", r("dr_m", "dr_m"))


@query("trk_set_displacement", "SELECT cluster, round(d_y, 6) AS d_y, round(d_x, 6) AS d_x FROM tracked WHERE d_y IS NOT NULL")
def trk_set_displacement(w):
    return w.tracks.tracked.where("d_y IS NOT NULL").select("cluster", r("d_y", "d_y"), r("d_x", "d_x"))


@query("trk_avg_velocity", "SELECT pair, round(avg(dr_m / dt), 6) AS velocity FROM matches GROUP BY pair")
def trk_avg_velocity(w):
    return w.tracks.matches.groupBy("pair").agg(r(F.avg(F.col("dr_m") / F.col("dt")), "velocity"))


@query("trk_new_ids", "SELECT scan, cluster, new_id FROM fresh")
def trk_new_ids(w):
    return w.tracks.fresh.select("scan", "cluster", "new_id")


@query("trk_ids", "SELECT cluster, id FROM ids")
def trk_ids(w):
    return w.tracks.ids


@query("trk_dropped_ids", "SELECT scan, id FROM simple_events WHERE kind = 'dropped'")
def trk_dropped_ids(w):
    return w.tracks.events.where("kind = 'dropped'").select("scan", "id")


@query("trk_merge_criterion", "SELECT n, m, round(merge_score, 6) AS score FROM scored WHERE shared > 0")
def trk_merge_criterion(w):
    return w.tracks.scored.where("shared > 0").select("n", "m", r("merge_score", "score"))


@query("trk_split_criterion", "SELECT n, m, round(split_score, 6) AS score FROM scored WHERE shared > 0")
def trk_split_criterion(w):
    return w.tracks.scored.where("shared > 0").select("n", "m", r("split_score", "score"))


@query("trk_merge_candidates", "SELECT pair, n, m, own FROM merge_candidates")
def trk_merge_candidates(w):
    return tracking.merge_candidates(w.tracks.scored, w.tracks.matches, tb.TRACKING).select("pair", "n", "m", "own")


@query("trk_merges", "SELECT pair, n, candidates, has_own FROM merge_events")
def trk_merges(w):
    return w.tracks.merges.select("pair", "n", "candidates", "has_own")


@query("trk_merge_events", "SELECT scan, id, part FROM merge_parts")
def trk_merge_events(w):
    return w.tracks.events.where("kind = 'merge'").select("scan", "id", F.explode("related").alias("part"))


@query("trk_split_candidates", "SELECT pair, n, m, own FROM split_candidates")
def trk_split_candidates(w):
    t = w.tracks
    tags, _ = tracking.merges(t.scored, t.matches, tb.TRACKING)[1], None
    links = t.matches.select("pair", "n", "m").unionByName(tags.select("pair", "n", "m"))
    return tracking.split_candidates(t.scored, links, tb.TRACKING).select("pair", "n", "m", "own")


@query("trk_splits", "SELECT pair, m, candidates, has_own FROM split_events")
def trk_splits(w):
    return w.tracks.splits.select("pair", "m", "candidates", "has_own")


@query("trk_split_events", "SELECT scan, id, part FROM split_parts")
def trk_split_events(w):
    return w.tracks.events.where("kind = 'split'").select("scan", "id", F.explode("related").alias("part"))


@query("trk_retag", "SELECT pair, n, m FROM retagged")
def trk_retag(w):
    return w.tracks.retagged


@query("trk_uuids", "SELECT scan, cluster, uuid FROM clusters")
def trk_uuids(w):
    return w.detection.clusters.select("scan", "cluster", "uuid")


@query("prj_advect", """
SELECT gid, round(m.c_y + coalesce(t.d_y, 0), 6) AS c_y, round(m.c_x + coalesce(t.d_x, 0), 6) AS c_x FROM members m JOIN tracked t ON t.cluster = m.cluster""")
def prj_advect(w):
    out = tracking.advect(w.detection.members, w.tracks.tracked, tb.GRID)
    return out.select("gid", r("c_y", "c_y"), r("c_x", "c_x"))


# --- satellite helpers that need clusters of two scans ---------------------------------------------------------


@query("w_ci_overlap", """
SELECT c.scan, c.pid FROM members c JOIN pairs l ON l.scan = c.scan AND l.linked JOIN members p ON p.scan = l.prev_scan AND p.pid = c.pid""")
def w_ci_overlap(w):
    from skytrace.plans.satellite import overlap_area

    return overlap_area(w.detection.members, w.tracks.pairs)


CTES["shift_target"] = """
SELECT k.pair AS scan, CAST(round(m.c_y + t.d_y) AS INTEGER) AS y, CAST(round(m.c_x + t.d_x) AS INTEGER) AS x, m.pid AS source, m.u
FROM matches k JOIN members m ON m.cluster = k.m JOIN tracked t ON t.cluster = k.n"""


@query("w_ci_shift", """
SELECT scan, y, x, arg_max(u, source) AS u FROM shift_target WHERE y BETWEEN 0 AND 24 AND x BETWEEN 0 AND 26 GROUP BY scan, y, x""")
def w_ci_shift(w):
    from skytrace.plans.satellite import shift_comparison

    return shift_comparison(w.detection.members, w.tracks.matches, w.tracks.tracked, tb.GRID, ["u"])


CTES["cold_cells"] = f"""
SELECT scan, y, x, msevi_l15_ir_108 AS ir FROM channel_cells WHERE msevi_l15_ir_108 >= 40 AND msevi_l15_ir_108 <= 130 AND msevi_l15_ir_108 <= {freezing_radiance()!r}"""
_WIDTH = scale_to_filter_width(4.0)
detection_chain(
    "proto", "cold_cells", ["ir"], smoothing_taps(4.0, 1.0), "CASE WHEN original THEN 1e0 - coalesce(ir / nullif(hi_ir - lo_ir, 0), 0) ELSE 0e0 END",
    (_WIDTH, _WIDTH, 90.0), f"CASE WHEN d2 <= {_WIDTH!r} THEN 1e0 / {_WIDTH!r} ELSE 0e0 END", 10)


@query("w_ci_protoclusters", "SELECT scan, cluster, size, round(center_y, 6) AS center_y, round(center_x, 6) AS center_x FROM proto_clusters")
def w_ci_protoclusters(w):
    from skytrace.catalog.features import channel_cells
    from skytrace.plans.satellite import protoclusters

    cells = channel_cells(w).withColumn("msevi_l15_ir_108_raw", F.col("msevi_l15_ir_108"))
    found = protoclusters(cells, tb.GRID, (40.0, 130.0), scale=4.0, min_size=10)
    return found.clusters.select("scan", "cluster", "size", r("center_y", "center_y"), r("center_x", "center_x"))


# The whole chain: protoclusters are tracked by the statements above under other names, with their own time limit.
_CI = {"members": "proto_members", "clusters": "ci_objects", **{n: "ci_" + n for n in ("pairs", "shared_cells", "all_pairs", "flagged", "maxima", "scored", "matching", "matches")}}
for _name, _new in _CI.items():
    if _new.startswith("ci_") and _name != "clusters":
        CTES[_new] = re.sub(r"[A-Za-z_]\w*", lambda m: _CI.get(m[0], m[0]), CTES[_name]).replace("<= 915", "<= 930")
CTES["proto_members"] = """
SELECT g.scan, g.y, g.x, CAST(g.y AS DOUBLE) AS c_y, CAST(g.x AS DOUBLE) AS c_x, CAST(g.y * 27 + g.x AS BIGINT) AS pid, g.gid, c.cluster
FROM proto_g g JOIN proto_comp c ON c.gid = g.gid JOIN proto_clusters k ON k.cluster = c.cluster WHERE g.original"""
CTES["ci_objects"] = """
SELECT k.scan, k.cluster, k.size, k.center_y, k.center_x,
       avg(sqrt(((m.c_y - k.center_y)*1e3)*((m.c_y - k.center_y)*1e3) + ((m.c_x - k.center_x)*1e3)*((m.c_x - k.center_x)*1e3))) AS radius_m
FROM proto_clusters k JOIN proto_members m ON m.cluster = k.cluster GROUP BY ALL"""
_SCORED = {"t108": "msevi_l15_ir_108", "t62": "msevi_l15_wv_062", "t134": "msevi_l15_ir_134"}
CTES["ci_moved"] = f"""
SELECT scan, y, x, {', '.join(f'arg_max({c}, source) AS {c}' for c in _SCORED.values())} FROM (
SELECT k.pair AS scan, CAST(round(m.c_y + (n.center_y - p.center_y)) AS INTEGER) AS y, CAST(round(m.c_x + (n.center_x - p.center_x)) AS INTEGER) AS x,
       m.pid AS source, {', '.join('c.' + c for c in _SCORED.values())}
FROM ci_matches k JOIN ci_objects n ON n.cluster = k.n JOIN ci_objects p ON p.cluster = k.m JOIN proto_members m ON m.cluster = k.m
JOIN channel_cells c ON c.scan = m.scan AND c.y = m.y AND c.x = m.x) WHERE y BETWEEN 0 AND 24 AND x BETWEEN 0 AND 26 GROUP BY scan, y, x"""
CTES["ci_overlap"] = """
SELECT DISTINCT c.scan, c.pid FROM proto_members c JOIN ci_pairs l ON l.scan = c.scan AND l.linked JOIN proto_members p ON p.scan = l.prev_scan AND p.pid = c.pid"""
for _tag, _source in (("ci_now", "channel_cells"), ("ci_then", "ci_moved")):
    for _t, _c in _SCORED.items():
        CTES[f"{_tag}_{_t}"] = f"""
SELECT scan, y, x, {_bt('avg(v)', _c)} AS {_t} FROM (
  SELECT a.scan, a.y, a.x, b.{_c} AS v, row_number() OVER (PARTITION BY a.scan, a.y, a.x ORDER BY b.{_c}) AS rn, count(*) OVER (PARTITION BY a.scan, a.y, a.x) AS n
  FROM {_source} a JOIN {_source} b ON b.scan = a.scan AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 WHERE a.{_c} IS NOT NULL AND b.{_c} IS NOT NULL)
WHERE rn <= round(n * 25e-2) GROUP BY scan, y, x"""
    CTES[_tag] = f"SELECT c.scan, c.y, c.x, {', '.join(_SCORED)} FROM {_source} c " + " ".join(f"LEFT JOIN {_tag}_{_t} USING (scan, y, x)" for _t in _SCORED)


@query("w_oase_ci_chain", f"""
SELECT p.scan, p.pid, CASE WHEN l.linked AND o.pid IS NULL THEN 0e0 WHEN s.radar THEN CASE WHEN l.linked THEN 8e0 ELSE 6e0 END
  WHEN s.lightning THEN q.score + 1e0 ELSE CAST(q.score AS DOUBLE) END AS w
FROM points p JOIN ci_pairs l ON l.scan = p.scan JOIN (
  SELECT n.scan, n.y, n.x, {_B('n.t108 <= 0')} + {_B('n.t62 - n.t108 <= 2')} + {_B('n.t134 - n.t108 >= -2')} + {_B('n.t108 - b.t108 <= -2')}
    + {_B('(n.t62 - n.t108) - (b.t62 - b.t108) >= 1')} + {_B('(n.t134 - n.t108) - (b.t134 - b.t108) >= 1')} AS score
  FROM ci_now n LEFT JOIN ci_then b ON b.scan = n.scan AND b.y = n.y AND b.x = n.x) q ON q.scan = p.scan AND q.y = p.y AND q.x = p.x
LEFT JOIN ci_overlap o ON o.scan = p.scan AND o.pid = p.pid
LEFT JOIN (SELECT a.scan, a.pid, bool_or(c.rx BETWEEN 25 AND 65) AS radar, bool_or(c.tl > 0) AS lightning FROM points a
  JOIN points b ON b.scan = a.scan AND abs(a.y-b.y) <= 2 AND abs(a.x-b.x) <= 2 AND (a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x) <= 4
  JOIN temperatures c ON c.scan = b.scan AND c.y = b.y AND c.x = b.x GROUP BY ALL) s ON s.scan = p.scan AND s.pid = p.pid""")
def w_oase_ci_chain(w):
    """Protoclusters, their tracks, the moved scan before, the overlap and the coldest quarter, all inside one weight."""
    from skytrace.catalog.features import channel_cells
    from skytrace.params import DetectionParams
    from skytrace.plans import satellite

    params = DetectionParams(variables=("v",), ci_compare_previous=True, ci_protocluster_scale=4.0, ci_protocluster_min_size=10)
    found = satellite.compare_with_previous(channel_cells(w).drop("ts"), w.scans, tb.GRID, (2.0, 2.0), (40.0, 130.0), params)
    return satellite.compared_weight(w.points, tb.GRID, found, (2.0, 2.0)).select("scan", "pid", "w")
