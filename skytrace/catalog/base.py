"""Registry of the checked queries, the stage tables they share, and the SQL side's common table expressions."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrace.functions.kernels import KERNELS
from skytrace.operators import aggregates, featurespace, meanshift
from skytrace.plans.detection import Detection, detect
from skytrace.plans.tracking import Tracks, graph, track
from skytrace.session import cut, keep
from skytrace.sources import tables as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class World:
    """Stage tables of one data folder, each computed once per session."""

    _known: dict[tuple[str, str], World] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> World:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._known:
            cls._known[key] = cls(spark, sf_dir)
        return cls._known[key]

    @classmethod
    def forget(cls) -> None:
        cls._known.clear()

    def table(self, name: str) -> DataFrame:
        return tb.table(self.spark, self.sf_dir, name)

    @cached_property
    def cells(self) -> DataFrame:
        # points, off-limits cells and scan times are all taken from them
        return keep(tb.cells(self.spark, self.sf_dir))

    @property
    def points(self) -> DataFrame:
        return featurespace.build(self.cells, tb.GRID, tb.VARIABLES, tb.DETECTION.lower, tb.DETECTION.upper)

    @property
    def weighted(self) -> DataFrame:
        from skytrace.functions.weights import default_weight

        return self.points.withColumn("w", default_weight(["v", "u"], tb.LIMITS))

    @cached_property
    def shifts(self) -> DataFrame:
        p = tb.DETECTION
        out = meanshift.shift_vectors(
            self.weighted, tb.GRID, ["v", "u"], p.ranges, KERNELS[p.kernel], p.kernel_size(tb.GRID), "w")
        return keep(out)

    @cached_property
    def detection(self) -> Detection:
        return detect(self.cells, tb.GRID, tb.VARIABLES, tb.DETECTION)

    @cached_property
    def scans(self) -> DataFrame:
        return cut(self.cells.select("scan", "ts").distinct())

    @cached_property
    def tracks(self) -> Tracks:
        d = self.detection
        return track(d.clusters, d.members, self.scans, tb.GRID, tb.TRACKING, tb.LIMITS)

    @cached_property
    def graph(self) -> tuple[DataFrame, DataFrame]:
        nodes, links = graph(self.tracks)
        return keep(nodes), keep(links)

    @cached_property
    def medians(self) -> DataFrame:
        members = self.detection.members
        med = aggregates.value_medians(members, ["v", "u"])
        return cut(med.select("cluster", F.col("v").alias("median_v"), F.col("u").alias("median_u")))

    @cached_property
    def tracked_members(self) -> DataFrame:
        """Members with their track id."""
        return self.detection.members.join(self.tracks.ids, "cluster")


def query(name: str, sql: str | None = None):
    """Register a Spark query under a name, with its SQL twin (common table expressions are prepended)."""

    def register(fn: Callable[[World], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(World.of(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


CTES: dict[str, str] = {}


def with_ctes(sql: str) -> str:
    """Prepend the table expressions a statement uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[A-Za-z_]\w*", text)):
            if word in CTES and word not in needed and word not in active:
                active.append(word)
                visit(CTES[word])
                active.remove(word)
                needed.append(word)

    active: list[str] = []
    visit(sql)
    if not needed:
        return sql
    parts = []
    for n in needed:
        body = CTES[n].strip()
        head = f"{n}{body}" if body.startswith("(") and ") USING KEY" in body[:80] else f"{n} AS MATERIALIZED ({body})"
        if body.startswith("RECURSIVE "):
            columns, rest = body[len("RECURSIVE "):].split("::", 1)
            head = f"{n}{columns.strip()} AS ({rest})"
        parts.append(head)
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + sql.strip()


def erfc_sql(z: str) -> str:
    """erfc of a non-negative argument by other means than the operator: a series with positive terms below 2, a continued fraction above."""
    series = f"exp(-({z})*({z})) * list_sum(list_transform(range(0, 60), lambda k: pow({z}, 2*k + 1) / gamma(k + 15e-1)))"
    fraction = f"({z})"
    for level in range(60, 0, -1):
        fraction = f"(({z}) + {level}e0/2e0/{fraction})"
    return f"(CASE WHEN ({z}) < 2e0 THEN 1e0 - {series} ELSE exp(-({z})*({z})) / sqrt(pi()) / {fraction} END)"


CTES["cells"] = """
SELECT scan, CAST(scan * 60 + CAST(floor(scan / 25e0) AS BIGINT) * 1000 AS BIGINT) AS ts, y, x, v_raw, u_raw
FROM (SELECT l_suppkey AS scan, CAST(floor((l_quantity - 1) / 2) AS INTEGER) AS y,
             CAST(floor((dayofyear(l_shipdate) - 1) / 14e0) AS INTEGER) AS x,
             CAST(CASE WHEN max(l_tax) >= 8e-2 THEN 255
                       ELSE least(sum(CAST(round(l_discount * 100) AS BIGINT)), 60) END AS INTEGER) AS v_raw,
             CAST(floor(max(l_extendedprice) / 1000) AS INTEGER) AS u_raw
      FROM lineitem GROUP BY 1, 2, 3)
"""

CTES["points"] = """
SELECT scan, ts, y, x, CAST(y AS DOUBLE) AS c_y, CAST(x AS DOUBLE) AS c_x, 5e-1 * v_raw AS v, CAST(u_raw AS DOUBLE) AS u,
       CAST(y * 27 + x AS BIGINT) AS pid, CAST(scan * 675 + y * 27 + x AS BIGINT) AS gid
FROM cells WHERE v_raw <> 255 AND 5e-1 * v_raw >= 15e-1 AND 5e-1 * v_raw <= 28e0 AND u_raw BETWEEN 0 AND 104
"""

CTES["weighted"] = "SELECT *, ((v - 0e0) / 30e0 + (u - 0e0) / 104e0) / 2e0 AS w FROM points"

CTES["sums"] = """
SELECT a.scan, a.gid, a.y, a.x, a.v, a.u, sum(k) AS total, sum(k * by_) AS sy, sum(k * bx) AS sx, sum(k * bv) AS sv, sum(k * bu) AS su
FROM (SELECT a.scan, a.gid, a.y, a.x, a.v, a.u, b.c_y AS by_, b.c_x AS bx, b.v AS bv, b.u AS bu, b.w AS bw,
             ((a.c_y-b.c_y)/2e0)*((a.c_y-b.c_y)/2e0) + ((a.c_x-b.c_x)/2e0)*((a.c_x-b.c_x)/2e0)
             + ((a.v-b.v)/10e0)*((a.v-b.v)/10e0) + ((a.u-b.u)/50e0)*((a.u-b.u)/50e0) AS d2,
             exp(-5e-1 * (((a.c_y-b.c_y)/2e0)*((a.c_y-b.c_y)/2e0) + ((a.c_x-b.c_x)/2e0)*((a.c_x-b.c_x)/2e0)
             + ((a.v-b.v)/10e0)*((a.v-b.v)/10e0) + ((a.u-b.u)/50e0)*((a.u-b.u)/50e0))) * 5e-1 * b.w AS k
      FROM weighted a JOIN weighted b ON a.scan = b.scan AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2) a
WHERE d2 <= 1 GROUP BY ALL
"""

CTES["shifts"] = """
SELECT *, g_y = 0 AND g_x = 0 AS zero_shift
FROM (SELECT scan, gid, y, x, v, u, round(dy, 6) AS f_y, round(dx, 6) AS f_x, CAST(round(round(dy, 6)) AS INTEGER) AS g_y,
             CAST(round(round(dx, 6)) AS INTEGER) AS g_x, dv AS s_v, du AS s_u
      FROM (SELECT *, CASE WHEN total <> 0 THEN sy / total - y ELSE 0e0 END AS dy,
                   CASE WHEN total <> 0 THEN sx / total - x ELSE 0e0 END AS dx,
                   CASE WHEN total <> 0 THEN sv / total - v ELSE 0e0 END AS dv,
                   CASE WHEN total <> 0 THEN su / total - u ELSE 0e0 END AS du FROM sums))
"""

CTES["zero_edges"] = """
SELECT a.scan, a.gid AS src, b.gid AS dst FROM shifts a JOIN shifts b
ON a.scan = b.scan AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.gid < b.gid
WHERE a.zero_shift AND b.zero_shift
"""

CTES["move_edges"] = """
SELECT a.scan, a.gid AS src, b.gid AS dst FROM shifts a
JOIN shifts b ON b.scan = a.scan AND b.y = a.y + a.g_y AND b.x = a.x + a.g_x WHERE NOT a.zero_shift
"""

CTES["arcs"] = """
SELECT src AS a, dst AS b FROM zero_edges UNION SELECT dst, src FROM zero_edges
UNION SELECT src, dst FROM move_edges UNION SELECT dst, src FROM move_edges
"""

CTES["comp"] = """RECURSIVE (gid, cluster) USING KEY (gid) ::
SELECT a, min(a) FROM arcs GROUP BY a
UNION
SELECT arcs.b, min(f.cluster) FROM comp AS f JOIN arcs ON arcs.a = f.gid JOIN recurring.comp AS cur ON cur.gid = arcs.b
WHERE f.cluster < cur.cluster GROUP BY arcs.b
"""

CTES["members"] = """
SELECT p.scan, p.ts, p.y, p.x, p.c_y, p.c_x, p.v, p.u, p.w, p.pid, p.gid, c.cluster
FROM weighted p JOIN comp c ON c.gid = p.gid
JOIN (SELECT cluster FROM comp GROUP BY cluster HAVING count(*) >= 3) k ON k.cluster = c.cluster
"""

CTES["margins"] = """
SELECT DISTINCT m.scan, m.cluster FROM members m JOIN cells c ON c.scan = m.scan AND abs(c.y - m.y) <= 1 AND abs(c.x - m.x) <= 1
WHERE c.v_raw = 255
"""

CTES["plain_clusters"] = """
SELECT scan, cluster, ts, count(*) AS size, min(pid) AS first_pid, avg(c_y) AS center_y, min(c_y) AS bbox_min_y, max(c_y) AS bbox_max_y,
       avg(c_x) AS center_x, min(c_x) AS bbox_min_x, max(c_x) AS bbox_max_x, avg(v) AS mode_v, min(v) AS min_v, max(v) AS max_v,
       avg(u) AS mode_u, min(u) AS min_u, max(u) AS max_u
FROM members GROUP BY scan, cluster, ts
"""

CTES["clusters"] = """
SELECT p.*, r.radius_m, g.cluster IS NOT NULL AS has_margin, row_number() OVER (ORDER BY p.cluster) AS uuid,
       row_number() OVER (PARTITION BY p.scan ORDER BY p.cluster) AS detection_id
FROM plain_clusters p
JOIN (SELECT m.cluster, avg(sqrt(((m.c_y - q.center_y)*1e3)*((m.c_y - q.center_y)*1e3) + ((m.c_x - q.center_x)*1e3)*((m.c_x - q.center_x)*1e3))) AS radius_m
      FROM members m JOIN plain_clusters q ON q.cluster = m.cluster GROUP BY m.cluster) r ON r.cluster = p.cluster
LEFT JOIN margins g ON g.cluster = p.cluster
"""



def smooth_pass(source: str, names: list[str], moving: str, fixed: str, size: int, taps: list[float], symmetric: bool = True) -> str:
    """One smoothing pass in SQL: every target i of a line collects the sources in its window."""
    reach = len(taps) - 1
    high, last = (reach, size - 1) if symmetric else (reach - 1, size - 2)
    k = f"CASE abs(s.{moving} - t.i) " + " ".join(f"WHEN {i} THEN {t!r}" for i, t in enumerate(taps)) + " END"
    sums = ", ".join(f"sum({k} * s.{n}) AS {n}" for n in names)
    return f"""
SELECT scan, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {', '.join(names)}, coalesce(original, false) AS original FROM (
SELECT s.scan, t.i AS {moving}, s.{fixed}, {sums}, bool_or(o.original) AS original
FROM {source} s JOIN range(0, {size}) t(i) ON s.{moving} - t.i BETWEEN {-reach} AND {high} AND s.{moving} <= {last}
LEFT JOIN {source} o ON o.scan = s.scan AND o.{fixed} = s.{fixed} AND o.{moving} = t.i GROUP BY s.scan, t.i, s.{fixed})"""


def detection_chain(tag: str, base: str, names: list[str], taps: list[float], weight: str, ranges: tuple[float, ...], kernel: str, minimum: int) -> None:
    """Smoothing to clusters as table expressions ``<tag>_...``. ``weight`` and ``kernel`` are SQL over the values, the scan's
    limits lo_/hi_ and the squared distance d2."""
    vals = ", ".join(names)
    CTES[f"{tag}_0"] = f"SELECT scan, y, x, {vals}, true AS original FROM {base}"
    CTES[f"{tag}_1"] = smooth_pass(f"{tag}_0", names, "y", "x", 25, taps)
    CTES[f"{tag}_2"] = smooth_pass(f"{tag}_1", names, "x", "y", 27, taps)
    limits = ", ".join(f"min({n}) OVER (PARTITION BY scan) AS lo_{n}, max({n}) OVER (PARTITION BY scan) AS hi_{n}" for n in names)
    CTES[f"{tag}_w"] = f"SELECT *, CAST(scan * 675 + y * 27 + x AS BIGINT) AS gid, {weight} AS w FROM (SELECT *, {limits} FROM {tag}_2)"
    square = lambda c, h: f"(CAST(a.{c}-b.{c} AS DOUBLE)/{float(h)!r}e0)*(CAST(a.{c}-b.{c} AS DOUBLE)/{float(h)!r}e0)"
    d2 = " + ".join(square(c, h) for c, h in zip(["y", "x", *names], ranges))
    ry, rx = (math.ceil(h) for h in ranges[:2])
    CTES[f"{tag}_g"] = f"""
SELECT scan, gid, y, x, original, CAST(round(round(coalesce(sum(k*ny)/nullif(sum(k), 0) - y, 0), 6)) AS INTEGER) AS g_y,
       CAST(round(round(coalesce(sum(k*nx)/nullif(sum(k), 0) - x, 0), 6)) AS INTEGER) AS g_x
FROM (SELECT *, {kernel} * nw AS k FROM (SELECT a.scan, a.gid, a.y, a.x, a.original, b.y AS ny, b.x AS nx, b.w AS nw, {d2} AS d2 FROM {tag}_w a
      JOIN {tag}_w b ON b.scan = a.scan AND abs(a.y-b.y) <= {ry} AND abs(a.x-b.x) <= {rx}) WHERE d2 <= 1) GROUP BY scan, gid, y, x, original"""
    CTES[f"{tag}_e"] = f"""
SELECT a.gid AS a, b.gid AS b FROM {tag}_g a JOIN {tag}_g b ON b.scan = a.scan AND abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1 AND a.gid <> b.gid
WHERE a.g_y = 0 AND a.g_x = 0 AND b.g_y = 0 AND b.g_x = 0
UNION SELECT a.gid, b.gid FROM {tag}_g a JOIN {tag}_g b ON b.scan = a.scan AND b.y = a.y + a.g_y AND b.x = a.x + a.g_x WHERE (a.g_y <> 0 OR a.g_x <> 0) AND a.original
UNION SELECT b.gid, a.gid FROM {tag}_g a JOIN {tag}_g b ON b.scan = a.scan AND b.y = a.y + a.g_y AND b.x = a.x + a.g_x WHERE (a.g_y <> 0 OR a.g_x <> 0) AND a.original"""
    CTES[f"{tag}_comp"] = f"""RECURSIVE (gid, cluster) USING KEY (gid) ::
SELECT a, min(a) FROM {tag}_e GROUP BY a
UNION
SELECT e.b, min(f.cluster) FROM {tag}_comp AS f JOIN {tag}_e e ON e.a = f.gid JOIN recurring.{tag}_comp AS cur ON cur.gid = e.b WHERE f.cluster < cur.cluster GROUP BY e.b"""
    CTES[f"{tag}_clusters"] = f"""
SELECT g.scan, c.cluster, count(*) AS size, avg(g.y) AS center_y, avg(g.x) AS center_x FROM {tag}_g g JOIN {tag}_comp c ON c.gid = g.gid
WHERE g.original GROUP BY g.scan, c.cluster HAVING count(*) >= {minimum}"""


CTES["medians"] = "SELECT cluster, median(v) AS median_v, median(u) AS median_u FROM members GROUP BY cluster"

CTES["pairs"] = """
SELECT scan, ts, step, prev_scan, CAST(ts - prev_ts AS DOUBLE) AS dt, coalesce(ts - prev_ts > 0 AND ts - prev_ts <= 915, false) AS linked
FROM (SELECT scan, ts, row_number() OVER (ORDER BY ts) - 1 AS step, lag(scan) OVER (ORDER BY ts) AS prev_scan,
             lag(ts) OVER (ORDER BY ts) AS prev_ts FROM (SELECT DISTINCT scan, ts FROM cells))
"""

CTES["shared_cells"] = """
SELECT c.scan AS pair, c.cluster AS n, p.cluster AS m, count(*) AS shared
FROM members c JOIN pairs l ON l.scan = c.scan AND l.linked JOIN members p ON p.scan = l.prev_scan AND p.pid = c.pid GROUP BY ALL
"""

CTES["all_pairs"] = """
SELECT l.scan AS pair, c.cluster AS n, p.cluster AS m, l.dt, c.size, p.size AS p_size, coalesce(s.shared, 0) AS shared,
       coalesce(s.shared, 0) / CAST(p.size AS DOUBLE) AS cover_old_by_new, coalesce(s.shared, 0) / CAST(c.size AS DOUBLE) AS cover_new_by_old,
       sqrt((c.center_y*1e3 - p.center_y*1e3)*(c.center_y*1e3 - p.center_y*1e3) + (c.center_x*1e3 - p.center_x*1e3)*(c.center_x*1e3 - p.center_x*1e3)) AS dr_m,
       CAST(greatest(c.size, p.size) - least(c.size, p.size) AS DOUBLE) AS size_diff,
       (greatest(c.size, p.size) - least(c.size, p.size)) / CAST(least(c.size, p.size) AS DOUBLE) AS size_deviation,
       p.radius_m >= 25e0 * l.dt AS needs_overlap
FROM pairs l JOIN clusters c ON c.scan = l.scan JOIN clusters p ON p.scan = l.prev_scan
LEFT JOIN shared_cells s ON s.n = c.cluster AND s.m = p.cluster WHERE l.linked
"""

CTES["flagged"] = """
SELECT *, (NOT needs_overlap OR shared > 0) AS overlap_ok, size_deviation <= 3 AS size_ok, dr_m <= 50e0 * dt AS velocity_ok,
       (NOT needs_overlap OR shared > 0) AND size_deviation <= 3 AND dr_m <= 50e0 * dt AS possible
FROM all_pairs
"""

CTES["maxima"] = """
SELECT pair, max(CASE WHEN possible THEN dr_m END) AS max_dr,
       CASE WHEN coalesce(max(CASE WHEN overlap_ok THEN size_diff END), 0) = 0 THEN 1e0
            ELSE max(CASE WHEN overlap_ok THEN size_diff END) END AS max_dh
FROM flagged GROUP BY pair
"""

_NEAR = erfc_sql("least(f.dr_m / greatest(coalesce(x.max_dr, 0), 1e-300), 30e0)")
_ALIKE = erfc_sql("least(f.size_diff / greatest(x.max_dh, 1e-300), 30e0)")
CTES["scored"] = f"""
SELECT f.*, x.max_dr, x.max_dh, round({_NEAR}, 9) AS likelihood, round(f.cover_new_by_old * ({_NEAR} + {_ALIKE}), 9) AS merge_score,
       round(f.cover_old_by_new * ({_NEAR} + {_ALIKE}), 9) AS split_score
FROM flagged f JOIN maxima x ON x.pair = f.pair WHERE f.possible OR f.shared > 0
"""

CTES["matching"] = """RECURSIVE (pair, n, m, likelihood, dr_m, dt, hit) ::
SELECT pair, n, m, likelihood, dr_m, dt, false FROM scored WHERE possible
UNION ALL
SELECT pair, n, m, likelihood, dr_m, dt, best
FROM (SELECT *, max(CASE WHEN best THEN 1 ELSE 0 END) OVER (PARTITION BY n) AS n_taken,
             max(CASE WHEN best THEN 1 ELSE 0 END) OVER (PARTITION BY m) AS m_taken
      FROM (SELECT *, rn = 1 AND rm = 1 AS best
            FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY likelihood DESC, m) AS rn,
                         row_number() OVER (PARTITION BY m ORDER BY likelihood DESC, n) AS rm FROM matching WHERE NOT hit)))
WHERE best OR (n_taken = 0 AND m_taken = 0)
"""

CTES["matches"] = "SELECT pair, n, m, likelihood, dr_m, dt FROM matching WHERE hit"

CTES["merge_candidates"] = """
SELECT pair, n, m, false AS own, cover_new_by_old AS cover, merge_score AS score
FROM (SELECT *, max(merge_score) OVER (PARTITION BY m) AS best FROM scored WHERE shared > 0 AND m NOT IN (SELECT m FROM matches))
WHERE cover_old_by_new >= 1e0 / 3 AND merge_score >= best
UNION ALL
SELECT s.pair, s.n, s.m, true, s.cover_new_by_old, s.merge_score FROM scored s JOIN matches k ON k.n = s.n AND k.m = s.m
"""

CTES["merge_events"] = """
SELECT pair, n, count(*) AS candidates, bool_or(own) AS has_own FROM merge_candidates GROUP BY pair, n HAVING count(*) > 1
"""

CTES["merge_tags"] = """
SELECT pair, m, min(n) AS n FROM (
  SELECT pair, n, min(m) AS m FROM (
    SELECT c.*, max(c.score) OVER (PARTITION BY c.n) AS top FROM merge_candidates c JOIN merge_events e ON e.n = c.n
    WHERE NOT e.has_own AND c.cover >= __CONT__) WHERE score = top GROUP BY pair, n HAVING count(*) = 1)
GROUP BY pair, m
"""

CTES["first_links"] = "SELECT pair, n, m FROM matches UNION ALL SELECT pair, n, m FROM merge_tags"

CTES["split_candidates"] = """
SELECT pair, n, m, false AS own, cover_old_by_new AS cover, split_score AS score
FROM (SELECT *, max(split_score) OVER (PARTITION BY n) AS best FROM scored WHERE shared > 0 AND n NOT IN (SELECT n FROM first_links))
WHERE cover_new_by_old >= 1e0 / 3 AND split_score >= best
UNION ALL
SELECT s.pair, s.n, s.m, true, s.cover_old_by_new, s.split_score FROM scored s JOIN first_links k ON k.n = s.n AND k.m = s.m
"""

CTES["split_events"] = """
SELECT pair, m, count(*) AS candidates, bool_or(own) AS has_own FROM split_candidates GROUP BY pair, m HAVING count(*) > 1
"""

CTES["split_tags"] = """
SELECT pair, n, min(m) AS m FROM (
  SELECT pair, m, min(n) AS n FROM (
    SELECT c.*, max(c.score) OVER (PARTITION BY c.m) AS top FROM split_candidates c JOIN split_events e ON e.m = c.m
    WHERE NOT e.has_own AND c.cover >= __CONT__) WHERE score = top GROUP BY pair, m HAVING count(*) = 1)
GROUP BY pair, n
"""

CTES["retagged"] = "SELECT pair, n, m FROM merge_tags UNION ALL SELECT pair, n, m FROM split_tags"

CTES["links_up"] = "SELECT n, m FROM matches UNION ALL SELECT n, m FROM retagged"

CTES["fresh"] = """
SELECT scan, cluster, row_number() OVER (ORDER BY cluster) AS new_id FROM clusters WHERE cluster NOT IN (SELECT n FROM matches)
"""

CTES["ids"] = """RECURSIVE (cluster, id) ::
SELECT f.cluster, f.new_id FROM fresh f WHERE f.cluster NOT IN (SELECT n FROM links_up)
UNION ALL
SELECT l.n, i.id FROM ids i JOIN links_up l ON l.m = i.cluster
"""

CTES["tracked"] = """
SELECT c.*, i.id, l.step, l.dt, c.center_y - p.center_y AS d_y, c.center_x - p.center_x AS d_x
FROM clusters c JOIN ids i ON i.cluster = c.cluster JOIN pairs l ON l.scan = c.scan
LEFT JOIN matches k ON k.n = c.cluster LEFT JOIN clusters p ON p.cluster = k.m
"""

CTES["simple_events"] = """
SELECT k.pair AS scan, 'tracked' AS kind, i.id FROM links_all k JOIN ids i ON i.cluster = k.m
UNION ALL
SELECT c.scan, 'new', i.id FROM clusters c JOIN ids i ON i.cluster = c.cluster WHERE c.cluster NOT IN (SELECT n FROM links_up)
UNION ALL
SELECT l.scan, 'dropped', i.id FROM clusters c JOIN pairs l ON l.prev_scan = c.scan AND l.linked JOIN ids i ON i.cluster = c.cluster
WHERE c.cluster NOT IN (SELECT m FROM matches)
"""

CTES["links_all"] = "SELECT pair, n, m FROM matches UNION ALL SELECT pair, n, m FROM retagged"

CTES["merge_parts"] = """
SELECT DISTINCT l.step, e.pair AS scan, a.id, b.id AS part FROM merge_events e JOIN merge_candidates c ON c.n = e.n JOIN ids a ON a.cluster = c.n
JOIN ids b ON b.cluster = c.m JOIN pairs l ON l.scan = e.pair
"""

CTES["split_parts"] = """
SELECT DISTINCT l.step, e.pair AS scan, a.id, b.id AS part FROM split_events e JOIN split_candidates c ON c.m = e.m JOIN ids a ON a.cluster = c.m
JOIN ids b ON b.cluster = c.n JOIN pairs l ON l.scan = e.pair
"""

CTES["nodes"] = "SELECT uuid, id, step, size FROM tracked"

CTES["graph_links"] = """
SELECT DISTINCT source, target, type, id FROM (
SELECT s.uuid AS source, t.uuid AS target, 0 AS type, s.id FROM simple_events e JOIN pairs l ON l.scan = e.scan
  JOIN nodes t ON t.step = l.step AND t.id = e.id JOIN nodes s ON s.step = l.step - 1 AND s.id = e.id WHERE e.kind = 'tracked'
UNION ALL
SELECT s.uuid, t.uuid, 1, s.id FROM split_parts e JOIN nodes s ON s.step = e.step - 1 AND s.id = e.id JOIN nodes t ON t.step = e.step AND t.id = e.part
UNION ALL
SELECT s.uuid, t.uuid, 2, t.id FROM merge_parts e JOIN nodes s ON s.step = e.step - 1 AND s.id = e.part JOIN nodes t ON t.step = e.step AND t.id = e.id)
"""

CTES["lengths"] = "SELECT id, count(*) AS length FROM tracked GROUP BY id"

for _name in ("merge_tags", "split_tags"):
    CTES[_name] = CTES[_name].replace("__CONT__", repr(tb.TRACKING.continuation_threshold) + "e0")
