"""Row-level operators: feature space, thresholds, projections, satellite conversions, weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytrace.catalog.base import CTES, query
from skytrace.catalog.scans import r
from skytrace.functions import satellite, weights
from skytrace.operators import featurespace, filters, parallax
from skytrace.operators.featurespace import Variable
from skytrace.params import DetectionParams
from skytrace.sources import tables as tb


@query("fs_build", "SELECT scan, ts, pid, y, x, c_y, c_x, v, u FROM points")
def fs_build(w):
    return w.points.select("scan", "ts", "pid", "y", "x", "c_y", "c_x", "v", "u")


@query("fs_build_axis", """
SELECT c.scan, c.y, c.x, ay.coord AS c_y, ax.coord AS c_x, 5e-1 * v_raw AS v FROM cells c
JOIN (SELECT DISTINCT y AS idx, y * y / 10e0 AS coord FROM cells) ay ON ay.idx = c.y
JOIN (SELECT DISTINCT x AS idx, x * 3e0 AS coord FROM cells) ax ON ax.idx = c.x WHERE v_raw <> 255""")
def fs_build_axis(w):
    axis = w.cells.select(F.explode(F.array(
        F.struct(F.lit("y").alias("dim"), F.col("y").alias("idx"), (F.col("y") * F.col("y") / 10.0).alias("coord")),
        F.struct(F.lit("x").alias("dim"), F.col("x").alias("idx"), (F.col("x") * 3.0).alias("coord")),
    )).alias("a")).select("a.*").distinct()
    points = featurespace.build(w.cells, tb.GRID, [tb.V]).drop("c_y", "c_x")
    return featurespace.coordinates_from_axis(points, axis, tb.GRID).select("scan", "y", "x", "c_y", "c_x", "v")


@query("fs_lower_threshold", "SELECT scan, y, x, 5e-1 * v_raw AS v FROM cells WHERE v_raw <> 255 AND 5e-1 * v_raw >= 4")
def fs_lower_threshold(w):
    return featurespace.build(w.cells, tb.GRID, [tb.V], lower={"v": 4.0}).select("scan", "y", "x", "v")


@query("fs_upper_threshold", "SELECT scan, y, x, 5e-1 * v_raw AS v FROM cells WHERE v_raw <> 255 AND 5e-1 * v_raw <= 4")
def fs_upper_threshold(w):
    return featurespace.build(w.cells, tb.GRID, [tb.V], upper={"v": 4.0}).select("scan", "y", "x", "v")


@query("fs_replacement_value", """
SELECT scan, y, x, CASE WHEN v_raw <> 255 AND 5e-1 * v_raw >= 2 AND 5e-1 * v_raw <= 8 THEN 5e-1 * v_raw ELSE 99e0 END AS v,
       CAST(u_raw AS DOUBLE) AS u FROM cells WHERE u_raw >= 10 AND u_raw <= 104""")
def fs_replacement_value(w):
    out = featurespace.build(w.cells, tb.GRID, tb.VARIABLES, {"v": 2.0, "u": 10.0}, {"v": 8.0}, {"v": 99.0})
    return out.select("scan", "y", "x", "v", "u")


@query("fs_off_limits", "SELECT scan, y, x, v_raw = 255 AS off_limits FROM cells")
def fs_off_limits(w):
    return w.cells.select("scan", "y", "x", featurespace.off_limits(tb.VARIABLES).alias("off_limits"))


@query("fs_minmax", "SELECT scan, min(v) AS v_min, max(v) AS v_max, min(u) AS u_min, max(u) AS u_max FROM points GROUP BY scan")
def fs_minmax(w):
    return featurespace.value_ranges(w.points, ["v", "u"], ["scan"])


@query("fs_threshold_all", "SELECT scan, pid, v, u FROM points WHERE c_y >= 3 AND c_x >= 2 AND v >= 2 AND u >= 30")
def fs_threshold_all(w):
    return featurespace.threshold_all(w.points, {"c_y": 3, "c_x": 2, "v": 2, "u": 30}).select("scan", "pid", "v", "u")


@query("flt_weight", "SELECT scan, pid, round(w, 6) AS w FROM weighted WHERE w >= 2e-1 AND w <= 5e-1")
def flt_weight(w):
    return filters.weight_between(w.weighted, 0.2, 0.5).select("scan", "pid", r("w", "w"))


@query("flt_min_size", """
SELECT scan, cluster, count(*) AS size FROM members GROUP BY scan, cluster HAVING count(*) >= 10""")
def flt_min_size(w):
    from skytrace.operators import clustering

    return clustering.sizes(clustering.at_least(w.detection.members, 10))


@query("prj_lookup", "SELECT scan, pid, c_y, c_x FROM points")
def prj_lookup(w):
    return w.points.select("scan", "pid", "c_y", "c_x")


@query("prj_reverse_lookup", """
SELECT event_id, CASE WHEN i BETWEEN 0 AND 24 THEN i END AS y FROM (SELECT event_id, CAST(round(value / 10) AS INTEGER) AS i FROM events)""")
def prj_reverse_lookup(w):
    return w.table("events").select("event_id", featurespace.reverse_lookup(F.col("value") / 10, tb.GRID, "y").alias("y"))


@query("prj_round_to_grid", "SELECT event_id, round(value / 25e-1) * 25e-1 AS rounded, round(-value / 25e-1) * 25e-1 AS mirrored FROM events")
def prj_round_to_grid(w):
    v = F.col("value")
    return w.table("events").select(
        "event_id", featurespace.round_to_grid(v, 2.5).alias("rounded"), featurespace.round_to_grid(-v, 2.5).alias("mirrored")
    )


@query("prj_to_gridpoints", "SELECT event_id, CAST(round(value / 25e-1) AS INTEGER) AS steps FROM events")
def prj_to_gridpoints(w):
    return w.table("events").select("event_id", featurespace.to_gridpoints(F.col("value"), 2.5).alias("steps"))


@query("prj_round_to_resolution", "SELECT scan, pid, round(v / 2e0) * 2e0 AS v, round(u / 5e0) * 5e0 AS u FROM points")
def prj_round_to_resolution(w):
    fit = lambda c, res: featurespace.round_to_grid(F.col(c), res).alias(c)
    return w.points.select("scan", "pid", fit("v", 2.0), fit("u", 5.0))


@query("prj_to_meters", "SELECT scan, pid, c_y * 1000 AS y_m, c_x * 1e0 AS x_m FROM points")
def prj_to_meters(w):
    return w.points.select(
        "scan", "pid", featurespace.to_meters(F.col("c_y"), "km").alias("y_m"), featurespace.to_meters(F.col("c_x"), "m").alias("x_m")
    )


@query("prj_spatial_component", "SELECT scan, pid, c_y AS first, c_x AS second FROM points")
def prj_spatial_component(w):
    spatial = F.slice(F.array("c_y", "c_x", "v", "u"), 1, len(tb.GRID.dims))
    return w.points.select("scan", "pid", spatial[0].alias("first"), spatial[1].alias("second"))


@query("prj_linear_index", """
SELECT scan, CAST((l_linenumber - 1) * 675 + y * 27 + x AS BIGINT) AS idx, CAST(l_linenumber - 1 AS INTEGER) AS z, y, x FROM (
SELECT l_suppkey AS scan, l_linenumber, CAST(floor((l_quantity - 1) / 2) AS INTEGER) AS y, CAST(floor((dayofyear(l_shipdate) - 1) / 14e0) AS INTEGER) AS x
FROM lineitem)""")
def prj_linear_index(w):
    axes = tb._axes(None)
    rows = w.table("lineitem").select(*[c.alias(n) for n, c in axes.items()], (F.col("l_linenumber") - 1).alias("z"))
    coded = rows.select("scan", featurespace.linear_index(tb.GRID_3D).alias("idx"))
    return coded.select("scan", "idx", *[c.alias(d) for d, c in featurespace.grid_point(F.col("idx"), tb.GRID_3D).items()])


@query("prj_satconv_bt", "SELECT scan, pid, " + ", ".join(
    f"round((({satellite.C2!r}e0 * {nu}e0 / ln(1e0 + {nu ** 3 * satellite.C1!r} / (v + 1e0))) - {b}e0) / {a}e0 - 27315e-2, 6) AS {n}"
    for n, (a, b, nu) in satellite.CHANNELS.items()) + " FROM points")
def prj_satconv_bt(w):
    return w.points.select("scan", "pid", *[r(satellite.brightness_temperature(F.col("v") + 1.0, n), n) for n in satellite.CHANNELS])


@query("prj_satconv_rad", "SELECT scan, pid, " + ", ".join(
    f"round({nu ** 3 * satellite.C1!r} / (exp({satellite.C2!r}e0 * {nu}e0 / ((u - 60e0 + 27315e-2) * {a}e0 + {b}e0)) - 1e0), 6) AS {n}"
    for n, (a, b, nu) in satellite.CHANNELS.items()) + " FROM points")
def prj_satconv_rad(w):
    return w.points.select("scan", "pid", *[r(satellite.spectral_radiance(F.col("u") - 60.0, n), n) for n in satellite.CHANNELS])


_SAT = satellite.Satellite(42164.0, 0.0, 9.5)
_FLAT = f"{(satellite.RADIUS_EQUATOR / satellite.RADIUS_POLE) ** 2!r}"
_SEEN = "SELECT scan, pid, 45e0 + c_y * 4e-1 AS lat, 3e0 + c_x * 5e-1 AS lon, v / 2e0 AS h FROM points"
# by bisection along the line of sight: the share of the way to the satellite at which the raised ellipsoid's equation turns positive
CTES["sight"] = f"""
SELECT scan, pid, h, ring * sin(lo) AS x, ring * k AS y, ring * cos(lo) AS z, 42164e0 * sin(radians(95e-1)) AS sx, 42164e0 * cos(radians(95e-1)) AS sz
FROM (SELECT *, 6378077e-3 / sqrt(1e0 + {_FLAT} * k * k) AS ring FROM (SELECT scan, pid, h, {_FLAT} * tan(radians(lat)) AS k, radians(lon) AS lo FROM ({_SEEN})))"""
CTES["bisected"] = """RECURSIVE (scan, pid, step, lo, hi) ::
SELECT scan, pid, 0, 0e0, 1e-1 FROM sight
UNION ALL
SELECT scan, pid, step + 1, CASE WHEN inside THEN mid ELSE lo END, CASE WHEN inside THEN hi ELSE mid END FROM (
  SELECT b.scan, b.pid, step, lo, hi, (lo + hi) / 2e0 AS mid,
         pow((x + (lo + hi) / 2e0 * (sx - x)) / (6378077e-3 + h), 2) + pow((y - (lo + hi) / 2e0 * y) / (6356577e-3 + h), 2)
         + pow((z + (lo + hi) / 2e0 * (sz - z)) / (6378077e-3 + h), 2) < 1e0 AS inside
  FROM bisected b JOIN sight s ON s.scan = b.scan AND s.pid = b.pid WHERE step < 50)"""
_PARALLAX = f"""
SELECT scan, pid, round(degrees(atan(y * (1e0 - t) / sqrt(pow(x + t * (sx - x), 2) + pow(z + t * (sz - z), 2)) / {_FLAT})), 6) AS lat,
       round(degrees(atan2(x + t * (sx - x), z + t * (sz - z))), 6) AS lon
FROM (SELECT s.*, b.lo AS t FROM sight s JOIN bisected b ON b.scan = s.scan AND b.pid = s.pid AND b.step = 50)"""


@query("prj_parallax", _PARALLAX)
def prj_parallax(w):
    seen = w.points.select("scan", "pid", (F.col("c_y") * 0.4 + 45.0).alias("lat"), (F.col("c_x") * 0.5 + 3.0).alias("lon"), (F.col("v") / 2.0).alias("h"))
    lat, lon = satellite.parallax(F.col("lat"), F.col("lon"), F.col("h"), _SAT)
    return seen.select("scan", "pid", r(lat, "lat"), r(lon, "lon"))


CTES["moved_cells"] = """
SELECT scan, ty AS y, tx AS x, arg_max(u_raw, y * 27 + x) AS u_raw FROM (
  SELECT scan, y, x, u_raw, CASE WHEN ok THEN y + d ELSE 0 END AS ty, CASE WHEN ok THEN x + d ELSE 0 END AS tx
  FROM (SELECT *, y + d <= 24 AND x + d <= 26 AS ok FROM (SELECT scan, y, x, u_raw, CAST(floor(u_raw / 60e0) AS INTEGER) AS d FROM cells)))
GROUP BY scan, ty, tx
"""


def _moved(w):
    shift = F.floor(F.col("u_raw") / 60).cast("int")
    src = w.cells.select("scan", "y", "x", "u_raw", (F.col("y") + shift).alias("ny"), (F.col("x") + shift).alias("nx"))
    return parallax.scatter(src, tb.GRID, {"y": "ny", "x": "nx"}, "u_raw")


@query("prj_parallax_scatter", "SELECT scan, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, u_raw FROM moved_cells")
def prj_parallax_scatter(w):
    return _moved(w)


_HOLES = """
(SELECT c.scan, c.y, c.x, m.u_raw FROM cells c LEFT JOIN moved_cells o ON o.scan = c.scan AND o.y = c.y AND o.x = c.x
 JOIN moved_cells m ON m.scan = c.scan AND m.y BETWEEN c.y - 2 AND c.y + 1 AND m.x BETWEEN c.x - 2 AND c.x + 1 WHERE o.scan IS NULL)"""


@query("prj_parallax_fill", f"""
SELECT scan, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(u_raw AS DOUBLE) AS u FROM moved_cells
UNION ALL SELECT scan, y, x, round(avg(u_raw), 6) FROM {_HOLES} GROUP BY scan, y, x HAVING count(*) >= 8""")
def prj_parallax_fill(w):
    moved = _moved(w).withColumn("u", F.col("u_raw").cast("double"))
    return parallax.fill_holes(moved, w.cells, tb.GRID, "u").withColumn("u", F.round("u", 6))


@query("prj_parallax_fill_class", f"""
SELECT scan, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(floor(u_raw / 10e0) AS INTEGER) AS k FROM moved_cells
UNION ALL SELECT scan, y, x, k FROM (
  SELECT scan, y, x, k, sum(n) OVER (PARTITION BY scan, y, x) AS total, row_number() OVER (PARTITION BY scan, y, x ORDER BY n DESC, k) AS pos
  FROM (SELECT scan, y, x, CAST(floor(u_raw / 10e0) AS INTEGER) AS k, count(*) AS n FROM {_HOLES} GROUP BY ALL)) WHERE pos = 1 AND total >= 8""")
def prj_parallax_fill_class(w):
    moved = _moved(w).select("scan", "y", "x", F.floor(F.col("u_raw") / 10).cast("int").alias("k"))
    return parallax.fill_holes(moved, w.cells, tb.GRID, "k", categorical=True)


# --- weights -------------------------------------------------------------------------------------------------


@query("w_default", "SELECT scan, pid, round(w, 6) AS w FROM weighted")
def w_default(w):
    return w.weighted.select("scan", "pid", r("w", "w"))


@query("w_inverse", "SELECT scan, pid, round((1e0 - v / 30e0) + (1e0 - u / 104e0), 6) AS w FROM points")
def w_inverse(w):
    return w.points.select("scan", "pid", r(weights.inverse_weight(["v", "u"], tb.LIMITS), "w"))


@query("w_pow10", "SELECT scan, pid, round(ln(pow(v, 10) + pow(u, 10)), 6) AS w_log FROM points")
def w_pow10(w):
    return w.points.select("scan", "pid", r(F.log(weights.pow10_weight(["v", "u"])), "w_log"))


# the channels of a composite, derived from the two stored variables; NULL where the first is missing
_CHANNELS = {
    "cband_radolan_rx": ("2e0 * v", lambda v, u: v * 2.0),
    "linet_oase_tl": ("greatest(u - 95e0, 0e0)", lambda v, u: F.greatest(u - 95.0, F.lit(0.0))),
    "msevi_l15_ir_108": ("40e0 + 3e0 * v", lambda v, u: v * 3.0 + 40.0),
    "msevi_l15_wv_062": ("1e0 + 8e-2 * u", lambda v, u: u * 0.08 + 1.0),
    "msevi_l15_ir_134": ("50e0 + v", lambda v, u: v + 50.0),
    "msevi_l2_nwcsaf_ct": ("floor(u / 5e0)", lambda v, u: F.floor(u / 5.0).cast("double")),
}
_CHANNEL_LIMITS = {"cband_radolan_rx": (0.0, 60.0), "linet_oase_tl": (0.0, 9.0), "msevi_l15_ir_108": (40.0, 130.0), "msevi_l2_nwcsaf_ct": (0.0, 20.0)}
CTES["channels"] = "SELECT *, " + ", ".join(f"{sql} AS {n}" for n, (sql, _) in _CHANNELS.items()) + " FROM points"
CTES["channel_cells"] = "SELECT scan, ts, y, x, " + ", ".join(f"{sql} AS {n}" for n, (sql, _) in _CHANNELS.items()) + """
FROM (SELECT scan, ts, y, x, CASE WHEN v_raw <> 255 THEN 5e-1 * v_raw END AS v, CASE WHEN v_raw <> 255 THEN CAST(u_raw AS DOUBLE) END AS u FROM cells)"""


def channels(points):
    return points.withColumns({n: f(F.col("v"), F.col("u")) for n, (_, f) in _CHANNELS.items()})


def channel_cells(w):
    ok = F.col("v_raw") != 255
    stored = w.cells.select("scan", "ts", "y", "x", F.when(ok, F.col("v_raw") * 0.5).alias("v"), F.when(ok, F.col("u_raw").cast("double")).alias("u"))
    return channels(stored)


@query("w_oase", """
SELECT a.scan, a.pid, round(sum(exp(-5e-1 * sqrt(CAST((a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x) AS DOUBLE))) * 5e-1 * b.s), 6) AS w
FROM points a JOIN (SELECT scan, y, x, 10e0 * cband_radolan_rx / 60e0 + (msevi_l15_ir_108 - 40e0) / 90e0 + 10e0 * linet_oase_tl / 9e0
   + CASE WHEN msevi_l2_nwcsaf_ct BETWEEN 7 AND 8 THEN 1e0 WHEN msevi_l2_nwcsaf_ct BETWEEN 9 AND 10 THEN 15e-1
          WHEN msevi_l2_nwcsaf_ct BETWEEN 11 AND 12 THEN 2e0 WHEN msevi_l2_nwcsaf_ct BETWEEN 13 AND 14 THEN 25e-1 ELSE 0e0 END
   * CASE WHEN msevi_l2_nwcsaf_ct IN (7, 11, 13) THEN 2e0 ELSE 1e0 END AS s FROM channels) b
ON b.scan = a.scan AND abs(a.y-b.y) <= 2 AND abs(a.x-b.x) <= 2 AND (a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x) <= 4 GROUP BY ALL""")
def w_oase(w):
    names = ["cband_radolan_rx", "msevi_l15_ir_108", "linet_oase_tl", "msevi_l2_nwcsaf_ct"]
    out = weights.composite_weight(channels(w.points), tb.GRID, names, _CHANNEL_LIMITS, (2.0, 2.0))
    return out.select("scan", "pid", r("w", "w"))


def _bt(column: str, channel: str) -> str:
    a, b, nu = satellite.CHANNELS[channel]
    return f"((({satellite.C2!r}e0 * {nu}e0 / ln(1e0 + {nu ** 3 * satellite.C1!r} / {column})) - {b}e0) / {a}e0 - 27315e-2)"


CTES["temperatures"] = f"""
SELECT scan, y, x, cband_radolan_rx AS rx, linet_oase_tl AS tl, {_bt('msevi_l15_ir_108', 'msevi_l15_ir_108')} AS t108,
       {_bt('msevi_l15_wv_062', 'msevi_l15_wv_062')} AS t62, {_bt('msevi_l15_ir_134', 'msevi_l15_ir_134')} AS t134 FROM channel_cells
"""
_B = lambda cond: f"CASE WHEN {cond} THEN 1 ELSE 0 END"


@query("w_oase_ci", f"""
SELECT p.scan, p.pid, CASE WHEN s.radar THEN 8e0 WHEN s.lightning THEN q.score + 1e0 ELSE CAST(q.score AS DOUBLE) END AS w
FROM points p JOIN (
  SELECT n.scan, n.y, n.x, {_B('n.t108 <= 0')} + {_B('n.t62 - n.t108 <= 2')} + {_B('n.t134 - n.t108 >= -2')}
    + coalesce({_B('n.t108 - b.t108 <= -2')} + {_B('(n.t62 - n.t108) - (b.t62 - b.t108) >= 1')}
    + {_B('(n.t134 - n.t108) - (b.t134 - b.t108) >= 1')}, 0) AS score
  FROM temperatures n LEFT JOIN temperatures b ON b.scan = n.scan - 1 AND b.y = n.y AND b.x = n.x) q ON q.scan = p.scan AND q.y = p.y AND q.x = p.x
LEFT JOIN (SELECT a.scan, a.pid, bool_or(c.rx BETWEEN 25 AND 65) AS radar, bool_or(c.tl > 0) AS lightning FROM points a
  JOIN points b ON b.scan = a.scan AND abs(a.y-b.y) <= 2 AND abs(a.x-b.x) <= 2 AND (a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x) <= 4
  JOIN temperatures c ON c.scan = b.scan AND c.y = b.y AND c.x = b.x GROUP BY ALL) s ON s.scan = p.scan AND s.pid = p.pid""")
def w_oase_ci(w):
    now = channel_cells(w)
    before = now.withColumn("scan", F.col("scan") + 1)
    out = weights.initiation_weight(w.points, tb.GRID, now, (2.0, 2.0), comparison=before)
    return out.select("scan", "pid", "w")


@query("w_oase_ci_static", f"""
SELECT p.scan, p.pid, CAST({_B('t108 <= 0')} + {_B('t62 - t108 BETWEEN -35 AND -10')} + {_B('t134 - t108 BETWEEN -25 AND -5')} AS DOUBLE) AS w
FROM points p JOIN temperatures n ON n.scan = p.scan AND n.y = p.y AND n.x = p.x""")
def w_oase_ci_static(w):
    out = weights.initiation_weight(w.points, tb.GRID, channel_cells(w), (2.0, 2.0), satellite_only=True, original_limits=True)
    return out.select("scan", "pid", "w")


@query("w_example", "SELECT scan, pid, round(sqrt((c_y - 12e0)*(c_y - 12e0) + (c_x - 13e0)*(c_x - 13e0)), 6) AS w FROM points")
def w_example(w):
    return w.points.select("scan", "pid", r(weights.distance_weight(["c_y", "c_x"], [12.0, 13.0]), "w"))


@query("w_brightband", "SELECT scan, pid, 0e0 AS w FROM points")
def w_brightband(w):
    return w.points.select("scan", "pid", weights.brightband_weight().alias("w"))


@query("w_gaussian", "SELECT scan, pid, round(exp((v / 30e0 * (v / 30e0) + u / 104e0 * (u / 104e0)) / -1e0) * 3e0, 6) AS w FROM points")
def w_gaussian(w):
    scaled = w.points.select("scan", "pid", (F.col("v") / 30.0).alias("a"), (F.col("u") / 104.0).alias("b"))
    return scaled.select("scan", "pid", r(weights.gaussian_weight(["a", "b"]), "w"))


@query("w_last_variable", "SELECT scan, pid, u AS w FROM points")
def w_last_variable(w):
    return w.points.select("scan", "pid", weights.last_variable(["v", "u"]).alias("w"))
