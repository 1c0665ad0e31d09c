"""Track statistics, the track graph and their exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytrace.catalog.base import CTES, detection_chain, query
from skytrace.catalog.scans import _konrad_lines, r
from skytrace.operators import trackstats
from skytrace.operators.filters import smoothing_taps
from skytrace.params import (
    CLUSTER_CLASSES, DIRECTION_CLASSES, LENGTH_CLASSES, SIZE_CLASSES, SPEED_CLASSES,
)
from skytrace.session import cut
from skytrace.sources import files, sinks
from skytrace.sources import tables as tb


def classes_sql(source: str, value: str, classes: tuple, by: str = "") -> str:
    """Counts per class limit over all classes, overflow as NULL."""
    rows = ", ".join(f"({float(c)!r}e0)" for c in classes)
    limit = f"(SELECT min(c) FROM (VALUES {rows}) t(c) WHERE {value} <= c)"
    return f"""
SELECT class, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT CAST(c AS DOUBLE) AS class, 0 AS n FROM (VALUES {rows}) t(c) UNION ALL
  SELECT CAST({limit} AS DOUBLE), 1 FROM ({source})) GROUP BY class"""


@query("st_tracks", """
SELECT id, count(*) AS length, min(step) AS first_step, max(step) AS last_step, min(uuid) AS first_uuid, max(uuid) AS last_uuid, CAST(sum(size) AS BIGINT) AS cells FROM tracked GROUP BY id""")
def st_tracks(w):
    return w.tracks.tracked.groupBy("id").agg(
        F.count("*").alias("length"), F.min("step").alias("first_step"), F.max("step").alias("last_step"),
        F.min("uuid").alias("first_uuid"), F.max("uuid").alias("last_uuid"), F.sum("size").alias("cells"))


@query("st_nodes", "SELECT uuid, id, step, size FROM nodes")
def st_nodes(w):
    return w.graph[0]


@query("st_links", "SELECT source, target, type, id FROM graph_links")
def st_links(w):
    return w.graph[1]


@query("st_degenerates", "SELECT count(*) AS tracks, count(*) FILTER (WHERE length = 1) AS degenerates FROM lengths")
def st_degenerates(w):
    return trackstats.degenerates(trackstats.track_lengths(w.tracks.tracked))


@query("st_length_dist", "SELECT length, count(*) AS n FROM lengths GROUP BY length")
def st_length_dist(w):
    return trackstats.distribution(trackstats.track_lengths(w.tracks.tracked), "length")


@query("st_length_hist", classes_sql("SELECT length FROM lengths WHERE length > 1", "length", LENGTH_CLASSES))
def st_length_hist(w):
    lengths = trackstats.track_lengths(w.tracks.tracked).where("length > 1")
    return trackstats.class_histogram(lengths, "length", LENGTH_CLASSES)


CTES["long_tracks"] = "SELECT t.* FROM tracked t JOIN lengths l ON l.id = t.id WHERE l.length > 1"


def _long(w):
    return trackstats.without_degenerates(w.tracks.tracked, trackstats.track_lengths(w.tracks.tracked))


@query("st_size_hist", classes_sql("SELECT size FROM long_tracks", "size", CLUSTER_CLASSES))
def st_size_hist(w):
    return trackstats.class_histogram(_long(w), "size", CLUSTER_CLASSES)


CTES["speed_of"] = """
SELECT uuid, id, sqrt((d_y * 1e3) * (d_y * 1e3) + (d_x * 1e3) * (d_x * 1e3)) / dt AS speed FROM long_tracks WHERE d_y <> 0 OR d_x <> 0"""


@query("st_speeds", "SELECT uuid, id, round(speed, 6) AS speed FROM speed_of")
def st_speeds(w):
    return trackstats.speeds(_long(w), tb.GRID).select("uuid", "id", r("speed", "speed"))


@query("st_speed_hist", classes_sql("SELECT round(speed, 6) AS speed FROM speed_of", "speed", SPEED_CLASSES))
def st_speed_hist(w):
    speeds = trackstats.speeds(_long(w), tb.GRID).withColumn("speed", F.round("speed", 6))
    return trackstats.class_histogram(speeds, "speed", SPEED_CLASSES)


_ORIGIN = (-500.0, -4600.0)
CTES["direction_of"] = """
SELECT uuid, id, round((degrees(atan2(d_x, d_y)) + degrees(atan2(center_x - 500e0, -(center_y - 4600e0))) + 720e0) % 360e0, 6) AS direction
FROM long_tracks WHERE d_x <> 0 OR d_y <> 0"""


def _directions(w):
    return trackstats.directions(_long(w), "x", "y", _ORIGIN).withColumn("direction", F.round("direction", 6))


@query("st_directions", "SELECT uuid, id, direction FROM direction_of")
def st_directions(w):
    return _directions(w)


@query("st_direction_hist", classes_sql("SELECT direction FROM direction_of", "direction", DIRECTION_CLASSES))
def st_direction_hist(w):
    return trackstats.class_histogram(_directions(w), "direction", DIRECTION_CLASSES)


@query("st_projection", """
SELECT event_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (
SELECT event_id, degrees(asin((k*k - (x*x + y*y)) / (k*k + (x*x + y*y)))) AS lat, degrees(atan2(x, -y)) + 10e0 AS lon
FROM (SELECT event_id, value - 250e0 AS x, -4200e0 - (user_id % 32) AS y, 637004e-2 * (1e0 + sin(radians(60e0))) AS k FROM events))""")
def st_projection(w):
    lat, lon = trackstats.to_geographic(F.col("value") - 250.0, F.lit(-4200.0) - (F.col("user_id") % 32))
    return w.table("events").select("event_id", r(lat, "lat"), r(lon, "lon"))


@query("st_projection_inverse", "SELECT event_id, round(value - 250e0, 4) AS x, CAST(-4200e0 - (user_id % 32) AS DOUBLE) AS y FROM events")
def st_projection_inverse(w):
    lat, lon = trackstats.to_geographic(F.col("value") - 250.0, F.lit(-4200.0) - (F.col("user_id") % 32))
    x, y = trackstats.to_stereographic(lat, lon)
    return w.table("events").select("event_id", r(x, "x", 4), r(y, "y", 4))


CTES["visited"] = "SELECT i.id, m.pid, count(*) AS visits, sum(m.v) AS sum_v, sum(m.u) AS sum_u FROM members m JOIN ids i ON i.cluster = m.cluster GROUP BY i.id, m.pid"


@query("st_cum_size", "SELECT id, count(*) AS cells FROM visited GROUP BY id")
def st_cum_size(w):
    return trackstats.cumulated_sizes(w.tracked_members)


@query("st_cum_size_hist", classes_sql("SELECT cells FROM (SELECT id, count(*) AS cells FROM visited GROUP BY id)", "cells", SIZE_CLASSES))
def st_cum_size_hist(w):
    return trackstats.class_histogram(trackstats.cumulated_sizes(w.tracked_members), "cells", SIZE_CLASSES)


@query("st_cum_values", "SELECT id, pid, visits, sum_v, sum_u FROM visited")
def st_cum_values(w):
    return trackstats.cumulated(w.tracked_members, ["v", "u"])


@query("st_bin", "SELECT event_id, (SELECT min(c) FROM (VALUES " + ", ".join(f"({float(c)!r}e0)" for c in SIZE_CLASSES) + ") t(c) WHERE value * 300 <= c) AS class FROM events")
def st_bin(w):
    return w.table("events").select("event_id", trackstats.class_limit(F.col("value") * 300, SIZE_CLASSES).alias("class"))


@query("st_average", "SELECT round(CAST(sum(length * n) AS DOUBLE) / sum(n), 6) AS average, max(length) AS largest FROM (SELECT length, count(*) AS n FROM lengths GROUP BY length) WHERE length <> 1")
def st_average(w):
    dist = trackstats.distribution(trackstats.track_lengths(w.tracks.tracked), "length")
    return trackstats.weighted_average(dist, "length").withColumn("average", F.round("average", 6))


@query("st_average_cumulated", "SELECT round(CAST(sum(cells) AS DOUBLE) / count(*), 6) AS average, max(cells) AS largest FROM (SELECT id, count(*) AS cells FROM visited GROUP BY id)")
def st_average_cumulated(w):
    dist = trackstats.distribution(trackstats.cumulated_sizes(w.tracked_members), "cells")
    return trackstats.weighted_average(dist, "cells", ignore_one=False).withColumn("average", F.round("average", 6))


@query("st_max", "SELECT max(size) AS largest FROM tracked")
def st_max(w):
    return w.tracks.tracked.agg(F.max("size").alias("largest"))


@query("st_track_minmax", "SELECT id, count(*) AS length, min(min_v) AS min_v, max(max_v) AS max_v, min(min_u) AS min_u, max(max_u) AS max_u FROM tracked GROUP BY id")
def st_track_minmax(w):
    return trackstats.track_ranges(w.tracks.tracked, ["v", "u"])


def _records(w):
    lines = files.konrad_records(_konrad_lines(w))
    return lines.select("id", "ts", F.col("center_x").alias("x_km"), F.col("center_y").alias("y_km"), "num_core_pixels")


CTES["foreign_records"] = """
SELECT id, ts, num_core_pixels, CAST(printf('%.4f', (id % 32) * 10 + value / 100) AS DOUBLE) AS x_km, CAST(printf('%.4f', h * 10 + value / 100) AS DOUBLE) AS y_km
FROM (SELECT user_id AS id, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS ts, value, hour(ts) AS h, CAST(floor(value) AS BIGINT) % 50 AS num_core_pixels FROM events)"""
CTES["foreign_speed"] = """
SELECT id, ts, sqrt((x_km - px)*(x_km - px) + (y_km - py)*(y_km - py)) * 1e3 / (ts - pts) AS speed FROM (
SELECT *, lag(ts) OVER w AS pts, lag(x_km) OVER w AS px, lag(y_km) OVER w AS py FROM foreign_records WINDOW w AS (PARTITION BY id ORDER BY ts, x_km, y_km))
WHERE pts IS NOT NULL AND ts <> pts"""


@query("st_konrad", "SELECT id, ts, round(speed, 4) AS speed FROM foreign_speed")
def st_konrad(w):
    return trackstats.konrad_speeds(_records(w)).select("id", "ts", r("speed", "speed", 4))


@query("st_konrad_length", classes_sql("SELECT count(*) AS length FROM foreign_records GROUP BY id HAVING count(*) > 1", "length", LENGTH_CLASSES))
def st_konrad_length(w):
    lengths = trackstats.track_lengths(_records(w)).where("length > 1")
    return trackstats.class_histogram(lengths, "length", LENGTH_CLASSES)


@query("st_konrad_size", classes_sql("SELECT num_core_pixels FROM foreign_records", "num_core_pixels", CLUSTER_CLASSES))
def st_konrad_size(w):
    return trackstats.class_histogram(_records(w), "num_core_pixels", CLUSTER_CLASSES)


@query("st_konrad_time", """
SELECT o_orderkey, CAST(epoch(try_cast(printf('%04d-%02d-%02d', CASE WHEN yy > 50 THEN 1900 + yy ELSE 2000 + yy END, month(o_orderdate), day(o_orderdate)) AS TIMESTAMP)) AS BIGINT) AS ts
FROM (SELECT o_orderkey, o_orderdate, o_custkey % 100 AS yy FROM orders)""")
def st_konrad_time(w):
    """29 February of a common year has no time."""
    o = w.table("orders")
    parts = o.select("o_orderkey", (F.col("o_custkey") % 100).alias("year"), F.month("o_orderdate").alias("month"), F.dayofmonth("o_orderdate").alias("day"),
                     F.lit(0).alias("hour"), F.lit(0).alias("minute"))
    return parts.select("o_orderkey", files.konrad_time().alias("ts"))


@query("st_graph_filter", "SELECT t.uuid, t.id, t.step FROM tracked t JOIN lengths l ON l.id = t.id WHERE l.length >= 3")
def st_graph_filter(w):
    lengths = trackstats.track_lengths(w.tracks.tracked)
    return trackstats.track_filter(w.tracks.tracked, lengths, minimum=3).select("uuid", "id", "step")


@query("st_graph_lookup", """
SELECT l.source, l.target, l.type, a.id AS source_id, b.id AS target_id, b.size AS target_size FROM graph_links l
JOIN nodes a ON a.uuid = l.source JOIN nodes b ON b.uuid = l.target""")
def st_graph_lookup(w):
    nodes, links = w.graph
    a = nodes.select(F.col("uuid").alias("source"), F.col("id").alias("source_id"))
    b = nodes.select(F.col("uuid").alias("target"), F.col("id").alias("target_id"), F.col("size").alias("target_size"))
    return links.drop("id").join(a, "source").join(b, "target")


@query("st_length_index", "SELECT length, count(*) AS tracks, min(id) AS first_id, max(id) AS last_id FROM lengths GROUP BY length")
def st_length_index(w):
    return trackstats.length_index(trackstats.track_lengths(w.tracks.tracked))


CTES["walks"] = """RECURSIVE (root, uuid, level) ::
SELECT id, uuid, 0 FROM nodes
UNION
SELECT r.root, s.other, r.level + s.cost FROM walks r JOIN (
  SELECT source AS uuid, target AS other, CASE WHEN type = 0 THEN 0 ELSE 1 END AS cost FROM graph_links
  UNION SELECT target, source, CASE WHEN type = 0 THEN 0 ELSE 1 END FROM graph_links) s ON s.uuid = r.uuid WHERE r.level <= 1"""


@query("join_graph_component", "SELECT root, uuid, min(level) AS level FROM walks GROUP BY root, uuid")
def join_graph_component(w):
    """From every track: the nodes reachable over at most one split or merge, and their neighbours."""
    nodes, links = w.graph
    return trackstats.linked_nodes(links, nodes.select(F.col("id").alias("root"), "uuid"), max_level=1)


# several scales side by side: smoothing, then clusters of adjacent points above a threshold
_SCALES = (4.0, 8.0)
for _scale in _SCALES:
    detection_chain(
        f"at{_scale:.0f}", "points", ["v", "u"], smoothing_taps(_scale, 1.0),
        "(coalesce((v - lo_v) / nullif(hi_v - lo_v, 0), 0) + coalesce((u - lo_u) / nullif(hi_u - lo_u, 0), 0)) / 2e0",
        tb.DETECTION.ranges, "exp(-5e-1 * d2) * 5e-1", tb.DETECTION.min_cluster_size)


def _scales_sql() -> str:
    rows = ", ".join(f"({float(c)!r}e0)" for c in CLUSTER_CLASSES)
    sizes = " UNION ALL ".join(f"SELECT {s!r}e0 AS scale, size FROM at{s:.0f}_clusters" for s in _SCALES)
    return f"""
SELECT scale, class, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT DISTINCT scale, CAST(c AS DOUBLE) AS class, 0 AS n FROM ({sizes}), (VALUES {rows}) t(c) UNION ALL
  SELECT scale, CAST((SELECT min(c) FROM (VALUES {rows}) t(c) WHERE size <= c) AS DOUBLE), 1 FROM ({sizes})) GROUP BY scale, class"""


@query("st_scale_comparison", _scales_sql())
def st_scale_comparison(w):
    from dataclasses import replace

    from skytrace.plans.detection import detect

    out = None
    for scale in _SCALES:
        found = detect(w.cells, tb.GRID, tb.VARIABLES, replace(tb.DETECTION, scale=scale))
        sizes = found.clusters.select(F.lit(scale).alias("scale"), "size")
        out = sizes if out is None else out.unionByName(sizes)
    return trackstats.class_histogram(out, "size", CLUSTER_CLASSES, ["scale"])


# --- exports ---------------------------------------------------------------------------------------------------


def _dictionary(w):
    table = w.tracks.tracked.join(w.medians, "cluster").withColumn("source", F.concat(F.lit("scan-"), F.col("scan").cast("string"), F.lit(".nc")))
    return trackstats.dictionary_clusters(table, tb.GRID, ["v", "u"])


@query("sink_track_dictionary", """
SELECT id, max(steps) AS length, part, min(uuid) AS first_uuid, arg_min('scan-' || scan || '.nc', step) AS first_file, max(step) AS last_step, min(low_v) AS min_v, max(high_u) AS max_u,
       arg_min(CAST(ts AS BIGINT), step) AS first_time, arg_min(size, step) AS first_size
FROM (SELECT *, CAST((step - min(step) OVER t) // 4 AS BIGINT) AS part, count(*) OVER t AS steps, min(min_v) OVER t AS low_v, max(max_u) OVER t AS high_u
      FROM tracked WINDOW t AS (PARTITION BY id))
WHERE steps > 1 GROUP BY id, part""")
def sink_track_dictionary(w):
    """Read back from the JSON documents."""
    docs = sinks.dictionary_rows(_dictionary(w), ["v", "u"], steps=4)
    schema = """id bigint, length bigint, part bigint, min array<double>, max array<double>, clusters array<struct<uuid: bigint, sourcefile: string, step: bigint,
                timestamp: bigint, size: bigint>>"""
    d = docs.select(F.from_json("json", schema).alias("d")).select("d.*")
    return d.select(
        "id", "length", "part", F.col("clusters")[0]["uuid"].alias("first_uuid"), F.col("clusters")[0]["sourcefile"].alias("first_file"),
        F.element_at("clusters", -1)["step"].alias("last_step"), F.col("min")[0].alias("min_v"), F.col("max")[1].alias("max_u"),
        F.col("clusters")[0]["timestamp"].alias("first_time"), F.col("clusters")[0]["size"].alias("first_size"))


_LENGTH_HIST = classes_sql("SELECT length FROM lengths WHERE length > 1", "length", LENGTH_CLASSES)


@query("sink_stats_text", f"""
SELECT CASE WHEN class IS NULL THEN ' > 110,' || n ELSE CAST(class AS BIGINT) || ',' || n END AS line FROM ({_LENGTH_HIST})""")
def sink_stats_text(w):
    lengths = trackstats.track_lengths(w.tracks.tracked).where("length > 1")
    hist = trackstats.class_histogram(lengths, "length", LENGTH_CLASSES)
    return sinks.histogram_lines(hist, LENGTH_CLASSES[-1]).select("line")


@query("sink_gnuplot", "SELECT length || '  ' || count(*) AS line FROM lengths GROUP BY length")
def sink_gnuplot(w):
    return sinks.value_lines(trackstats.distribution(trackstats.track_lengths(w.tracks.tracked), "length"), "length")


@query("sink_tic_objects", """
SELECT step + 1 AS timestep, uuid AS id, round(center_x, 6) AS centerx, round(center_y, 6) AS centery, size AS volume, bbox_min_x AS boxxmin, bbox_max_x AS boxxmax,
       bbox_min_y AS boxymin, bbox_max_y AS boxymax, median_v AS lwpmean, min_v AS lwpmin, max_v AS lwpmax FROM long_tracks t JOIN medians m ON m.cluster = t.cluster""")
def sink_tic_objects(w):
    out = sinks.tic_objects(_long(w).join(w.medians, "cluster"), "v")
    return out.withColumns({"centerx": F.round("centerx", 6), "centery": F.round("centery", 6)})


@query("sink_tic_tracks", """
SELECT n.step + 1 AS timestep, l.source AS idstep1, l.target AS idstep2, CAST(0 AS BIGINT) AS weight FROM graph_links l JOIN nodes n ON n.uuid = l.source""")
def sink_tic_tracks(w):
    nodes, links = w.graph
    return sinks.tic_tracks(links, nodes)
