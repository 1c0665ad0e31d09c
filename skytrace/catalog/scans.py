"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from skytrace.catalog.base import CTES, World, query
from skytrace.operators import featurespace
from skytrace.session import cut, ensure_checkpoint_dir, store
from skytrace.sources import files, polylines, radar, sinks
from skytrace.sources import tables as tb


def r(c, name: str, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits).alias(name)


def up(c, name: str, digits: int = 6):
    """Rounded after a nudge of 1e-9, for values that often sit exactly on a half step."""
    return r((F.col(c) if isinstance(c, str) else c) + 1e-9, name, digits)


def scratch(w: World, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(w.spark)
    return f"{w.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("src_grid_scan", "SELECT scan, ts, y, x, v_raw, u_raw FROM cells")
def src_grid_scan(w):
    return w.cells


@query("src_grid_scan_3d", """
SELECT scan, z, y, x, v_raw, u_raw FROM (
SELECT l_suppkey AS scan, CAST(l_linenumber - 1 AS INTEGER) AS z, CAST(floor((l_quantity - 1) / 2) AS INTEGER) AS y,
       CAST(floor((dayofyear(l_shipdate) - 1) / 14e0) AS INTEGER) AS x,
       CAST(CASE WHEN max(l_tax) >= 8e-2 THEN 255 ELSE least(sum(CAST(round(l_discount * 100) AS BIGINT)), 60) END AS INTEGER) AS v_raw,
       CAST(floor(max(l_extendedprice) / 1000) AS INTEGER) AS u_raw
FROM lineitem GROUP BY 1, 2, 3, 4)""")
def src_grid_scan_3d(w):
    return tb.cells_3d(w.spark, w.sf_dir).drop("ts")


@query("src_unpack", """
SELECT scan, y, x, 5e-1 * v_raw AS v, v_raw <> 255 AS v_valid, v_raw <> 255 AS v_in_range,
       CAST(u_raw AS DOUBLE) AS u, true AS u_valid, u_raw >= 0 AND u_raw <= 104 AS u_in_range FROM cells""")
def src_unpack(w):
    return featurespace.unpack(w.cells, tb.VARIABLES).drop("ts", "v_raw", "u_raw")


@query("src_pack", "SELECT scan, y, x, CAST(v_raw AS DOUBLE) AS v_packed, CAST(u_raw AS DOUBLE) AS u_packed FROM cells")
def src_pack(w):
    unpacked = featurespace.unpack(w.cells, tb.VARIABLES)
    return unpacked.select(
        "scan", "y", "x", featurespace.pack_value(F.col("v"), tb.V).alias("v_packed"),
        featurespace.pack_value(F.col("u"), tb.U).alias("u_packed"),
    )


def _meta(w):
    rows = [(v.name, v.scale_factor, v.add_offset, v.valid_min, v.valid_max, v.fill_value) for v in tb.VARIABLES]
    return w.spark.createDataFrame(
        rows, "var string, scale_factor double, add_offset double, valid_min double, valid_max double, fill_value double"
    )


def _long(w):
    return w.cells.select(
        "scan", F.explode(F.array(*[
            F.struct(F.lit(v.name).alias("var"), F.col(v.name + "_raw").cast("double").alias("raw")) for v in tb.VARIABLES
        ])).alias("r")
    ).select("scan", "r.var", "r.raw")


@query("src_meta_limits", """
SELECT var, m.scale_factor, m.add_offset, m.valid_min, m.valid_max, m.fill_value, count(*) AS stored,
       count(*) FILTER (WHERE raw BETWEEN m.valid_min AND m.valid_max) AS in_limits
FROM (SELECT 'v' AS var, v_raw AS raw FROM cells UNION ALL SELECT 'u', u_raw FROM cells) c
JOIN (SELECT 'v' AS var, 5e-1 AS scale_factor, 0e0 AS add_offset, 0e0 AS valid_min, 60e0 AS valid_max, 255e0 AS fill_value
      UNION ALL SELECT 'u', 1e0, 0e0, 0e0, 104e0, CAST(NULL AS DOUBLE)) m USING (var)
GROUP BY ALL""")
def src_meta_limits(w):
    meta = _meta(w)
    # one metadata row per variable: always broadcastable
    counted = _long(w).join(F.broadcast(meta), "var")
    return counted.groupBy(*meta.columns).agg(
        F.count("*").alias("stored"), F.count_if(F.col("raw").between(F.col("valid_min"), F.col("valid_max"))).alias("in_limits")
    )


@query("src_attr_value", """
SELECT scan, var, CASE var WHEN 'v' THEN 5e-1 ELSE 1e0 END AS scale_factor, CASE var WHEN 'v' THEN 255e0 END AS fill_value,
       count(*) AS n FROM (SELECT scan, 'v' AS var FROM cells UNION ALL SELECT scan, 'u' FROM cells) GROUP BY ALL""")
def src_attr_value(w):
    attrs = _meta(w).select("var", F.map_from_arrays(
        F.array(F.lit("scale_factor"), F.lit("fill_value")), F.array("scale_factor", "fill_value")).alias("attrs"))
    joined = _long(w).join(F.broadcast(attrs), "var")
    return joined.groupBy(
        "scan", "var", F.col("attrs")["scale_factor"].alias("scale_factor"), F.col("attrs")["fill_value"].alias("fill_value")
    ).agg(F.count("*").alias("n"))


@query("src_axis", """
SELECT dim, count(*) AS size, min(coord) AS first_coord, max(coord) AS last_coord,
       round((max(coord) - min(coord)) / (count(*) - 1), 6) AS resolution
FROM (SELECT DISTINCT 'y' AS dim, CAST(y AS DOUBLE) AS coord FROM cells UNION SELECT 'x', CAST(x AS DOUBLE) FROM cells) GROUP BY dim""")
def src_axis(w):
    lines = w.cells.select(F.explode(F.array(*[
        F.struct(F.lit(d).alias("dim"), F.col(d).cast("double").alias("coord")) for d in tb.GRID.dims
    ])).alias("l")).select("l.dim", "l.coord").distinct()
    return lines.groupBy("dim").agg(
        F.count("*").alias("size"), F.min("coord").alias("first_coord"), F.max("coord").alias("last_coord"),
        r((F.max("coord") - F.min("coord")) / (F.count("*") - 1), "resolution"),
    )


@query("src_time", """
SELECT o_orderkey, CASE WHEN f THEN CAST(round(d * 86400) AS BIGINT) ELSE CAST(d AS BIGINT) END AS first_time,
       CASE WHEN f THEN CAST(round((d + 5e-1) * 86400) AS BIGINT) ELSE CAST(floor(d + 5e-1) AS BIGINT) END AS second_time,
       CAST(0 AS BIGINT) AS beyond
FROM (SELECT o_orderkey, CAST(dayofyear(o_orderdate) AS DOUBLE) AS d, o_orderpriority = '1-URGENT' AS f FROM orders)""")
def src_time(w):
    o = w.table("orders")
    day = F.dayofyear("o_orderdate").cast("double")
    times = F.array(day, day + 0.5)
    name = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("rico.out.xy.nc")).otherwise(F.lit("scan.nc"))
    return o.select(
        "o_orderkey", files.pick_time(times, -1, name).alias("first_time"), files.pick_time(times, 1, name).alias("second_time"),
        files.pick_time(times, 5, name).alias("beyond"),
    )


@query("src_ts_from_filename", """
SELECT event_id, CASE k WHEN 0 THEN CAST(epoch(date_trunc('minute', ts)) AS BIGINT) WHEN 1 THEN CAST(epoch(date_trunc('minute', ts)) AS BIGINT)
       WHEN 2 THEN CAST(epoch(date_trunc('minute', ts)) AS BIGINT) WHEN 3 THEN CAST(epoch(date_trunc('hour', ts)) AS BIGINT) END AS parsed
FROM (SELECT event_id, ts, event_id % 5 AS k FROM events)""")
def src_ts_from_filename(w):
    e = w.table("events")
    stamp = lambda p: F.date_format("ts", p)
    k = F.col("event_id") % 5
    name = (
        F.when(k == 0, F.concat(F.lit("raa01-rx_10000-"), stamp("yyMMddHHmm"), F.lit("-dwd---bin.nc")))
        .when(k == 1, F.concat(F.lit("oase-"), stamp("yyyyMMdd't'HHmm"), F.lit("z-1km-germany-2d-v01a.nc")))
        .when(k == 2, F.concat(F.lit("herz-oase-"), stamp("yyyyMMdd't'HHmm"), F.lit("utc-0500m-bonnjue-3d-v01a.nc")))
        .when(k == 3, F.concat(F.lit("tb_"), stamp("yyyyMMddHH"), F.lit("_150ghz.nc")))
        .otherwise(F.concat(F.lit("unknown-"), stamp("yyyyMMdd")))
    )
    return e.select("event_id", files.timestamp_from_name(name).alias("parsed"))


_HOURLY = "SELECT DISTINCT user_id, 'scan-' || strftime(ts, '%Y%m%d%H') || '-clusters.nc' AS name FROM events"


def _names(w):
    return w.table("events").select(
        "user_id", F.concat(F.lit("scan-"), F.date_format("ts", "yyyyMMddHH"), F.lit("-clusters.nc")).alias("name")
    )


@query("src_dir_scan", f"SELECT name, row_number() OVER (ORDER BY name) - 1 AS step FROM (SELECT DISTINCT name FROM ({_HOURLY}))")
def src_dir_scan(w):
    """One folder per file name is written, then the directory is listed."""
    path = scratch(w, "listing")
    _names(w).distinct().select("name", F.col("name").alias("value")).repartition("name").dropDuplicates(["name"]).write.partitionBy("name").text(path)
    return files.directory_steps(files.list_folders(w.spark, path, "name"))


@query("src_common_prefix", f"""
SELECT user_id, CASE WHEN lo = hi THEN lo ELSE substr(lo, 1, coalesce(
  (SELECT max(i) FROM range(1, 40) t(i) WHERE i <= length(lo) AND substr(lo, 1, i) = substr(hi, 1, i)), 0)) END AS prefix
FROM (SELECT user_id, min(name) AS lo, max(name) AS hi FROM ({_HOURLY}) GROUP BY user_id)""")
def src_common_prefix(w):
    return files.common_prefix(_names(w), ["user_id"])


def _konrad_lines(w):
    part = lambda p: F.date_format("ts", p)
    q = lambda c: F.format_string("%.4f", c)
    value = F.col("value")
    return w.table("events").select(F.concat_ws(
        "  ", part("yy"), part("MM"), part("dd"), part("HH"), part("mm"), F.col("user_id").cast("string"),
        (F.col("event_id") % 3).cast("string"), q(F.hour("ts") * 10 + value / 100), q((F.col("user_id") % 32) * 10 + value / 100),
        (F.floor(value) % 50).cast("string"), (F.floor(value) % 12).cast("string"), q((value * 7) % 360),
        (F.floor(value) % 60).cast("string"), (F.col("event_id") % 3).cast("string"), q(value / 10), q(value), q(value), q(value + 1), q(value + 1),
    ).alias("value"), "event_id")


@query("src_konrad_text", """
SELECT CAST(strftime(ts, '%y') AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, CAST(day(ts) AS BIGINT) AS day, CAST(hour(ts) AS BIGINT) AS hour,
       CAST(minute(ts) AS BIGINT) AS minute, user_id AS id, event_id % 3 AS cell_status, CAST(floor(value) AS BIGINT) % 50 AS num_core_pixels,
       CAST(floor(value) AS BIGINT) % 12 AS num_pixels, CAST(floor(value) AS BIGINT) % 60 AS lifetime, event_id % 3 AS hail_warning,
       round(hour(ts) * 10 + value / 100e0, 4) AS center_y, round((user_id % 32) * 10 + value / 100e0, 4) AS center_x, round((value * 7) % 360, 2) AS direction_deg,
       round(value / 10e0, 3) AS pixel_per_hour, round(value, 2) AS x_min, round(value + 1, 2) AS y_max,
       round(value, 2) AS y_min, round(value + 1, 2) AS x_max, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS ts FROM events""")
def src_konrad_text(w):
    return files.konrad_records(_konrad_lines(w)).select(
        "year", "month", "day", "hour", "minute", "id", "cell_status", "num_core_pixels", "num_pixels", "lifetime", "hail_warning",
        r("center_y", "center_y", 4), r("center_x", "center_x", 4), r("direction_deg", "direction_deg", 2), r("pixel_per_hour", "pixel_per_hour", 3),
        r("x_min", "x_min", 2), r("y_max", "y_max", 2), r("y_min", "y_min", 2), r("x_max", "x_max", 2), "ts",
    )


@query("src_radolan", """
SELECT scan, y, x, CAST(round((d + 325e-1) / 5e-1) AS INTEGER) AS byte, CASE WHEN d >= 0 THEN d ELSE -325e-1 END AS kept
FROM (SELECT scan, y, x, u_raw * 5e-1 - 10e0 AS d FROM cells)""")
def src_radolan(w):
    dbz = w.cells.select("scan", "y", "x", (F.col("u_raw") * 0.5 - 10.0).alias("dbz"))
    return dbz.select("scan", "y", "x", files.rvp6_byte(F.col("dbz")).alias("byte"), files.radar_threshold(F.col("dbz"), 0.0).alias("kept"))


# Composites of four products, one file per scan: two of one byte a pixel, two of two bytes with flags. Cells that the grid lacks are missing.
CTES["composite_cells"] = """
SELECT g.scan, g.y, g.x, g.scan % 4 AS kind, c.scan IS NULL AS gap, coalesce(c.v_raw = 255 AND g.x % 2 = 1, false) AS clutter, coalesce(c.v_raw = 255 AND g.x % 2 = 0, false) AS lost,
       coalesce(c.v_raw % 7 = 3, false) AS negative, coalesce(g.y = 3, false) AS secondary, coalesce(c.u_raw, 0) AS u
FROM (SELECT DISTINCT scan, y, x FROM (SELECT DISTINCT scan FROM cells), (SELECT unnest(range(0, 25)) AS y), (SELECT unnest(range(0, 27)) AS x)) g
LEFT JOIN cells c ON c.scan = g.scan AND c.y = g.y AND c.x = g.x"""


def _composites(w):
    """Written as (name, content) rows, which any store keeps, and read back."""
    kind, spoiled = F.col("scan") % 4, F.col("v_raw") == 255
    byte = F.when(spoiled & (F.col("x") % 2 == 1), radar.BYTE_CLUTTER).when(spoiled, radar.BYTE_MISSING).otherwise(F.col("u_raw"))
    flag = lambda cond, bits: F.when(cond, bits).otherwise(0)
    word = (F.col("u_raw") * 13).bitwiseOR(flag(F.col("y") == 3, radar.SECONDARY)).bitwiseOR(flag(spoiled & (F.col("x") % 2 == 0), radar.MISSING))
    word = word.bitwiseOR(flag(F.col("v_raw") % 7 == 3, radar.NEGATIVE)).bitwiseOR(flag(spoiled & (F.col("x") % 2 == 1), radar.CLUTTER))
    product = F.element_at(F.array(*map(F.lit, ("RX", "EX", "RY", "RW"))), (kind + 1).cast("int"))
    cells = w.cells.select(
        F.format_string("composite-%08d", F.col("scan")).alias("name"), product.alias("product"), ((F.col("scan") + 15_000_000) * 60).alias("ts"),
        F.when(kind == 2, -2).when(kind == 3, -1).otherwise(0).alias("precision"), (F.col("y") * 27 + F.col("x")).alias("pid"), F.when(kind < 2, byte).otherwise(word).alias("raw"))
    return store(radar.encoded(cells, 25, 27))


@query("src_radolan_files", """
SELECT 'composite-' || lpad(scan::VARCHAR, 8, '0') AS name, ['RX', 'EX', 'RY', 'RW'][kind + 1] AS product, (scan + 15000000) * 60 AS ts, y::INTEGER AS y, x::INTEGER AS x,
       gap OR lost AS missing, clutter, kind >= 2 AND secondary AND NOT gap AS secondary, CASE WHEN gap OR lost OR clutter THEN NULL WHEN v < 5 THEN CASE WHEN kind < 2 THEN -325e-1 ELSE 0e0 END ELSE v END AS value
FROM (SELECT *, round(CASE WHEN kind < 2 THEN u * 5e-1 - 325e-1 ELSE u * 13 * CASE kind WHEN 2 THEN 1e-2 ELSE 1e-1 END * CASE WHEN negative THEN -1 ELSE 1 END END, 6) AS v FROM composite_cells)""")
def src_radolan_files(w):
    found = radar.pixels(_composites(w), threshold=5.0)
    return found.select("name", "product", "ts", "y", "x", "missing", "clutter", "secondary", r("value", "value"))


@query("src_topography", """
SELECT scan, z, count(*) AS cells, CAST(sum(u_raw * 20) AS BIGINT) AS height_sum
FROM (SELECT scan, u_raw, unnest(range(0, CAST(greatest(least(ceil(u_raw * 20 / 1000e0 / 25e-2), 59), 0) AS BIGINT) + 1)) AS z FROM cells) GROUP BY ALL""")
def src_topography(w):
    heights = w.cells.select("scan", "y", "x", (F.col("u_raw") * 20).alias("height_m"))
    return files.topography_levels(heights, 60).groupBy("scan", F.col("z").cast("bigint").alias("z")).agg(
        F.count("*").alias("cells"), F.sum("height_m").alias("height_sum")
    )


@query("src_shapefile", """
SELECT o_orderkey, CAST(x0 + sign(x1 - x0) * least(greatest(k - greatest(ay - ax, 0), 0), ax) AS INTEGER) AS x,
       CAST(y0 + sign(y1 - y0) * least(greatest(k - greatest(ax - ay, 0), 0), ay) AS INTEGER) AS y
FROM (SELECT *, unnest(range(0, CASE WHEN ax > 0 AND ay > 0 THEN greatest(ax, ay) ELSE 0 END + 1)) AS k
      FROM (SELECT *, abs(x1 - x0) AS ax, abs(y1 - y0) AS ay
            FROM (SELECT o_orderkey, o_custkey % 50 AS x0, CAST(month(o_orderdate) AS BIGINT) AS y0, CAST(day(o_orderdate) AS BIGINT) AS x1,
                         o_orderkey % 40 AS y1 FROM orders)))""")
def src_shapefile(w):
    segments = w.table("orders").select(
        "o_orderkey", (F.col("o_custkey") % 50).alias("x0"), F.month("o_orderdate").cast("bigint").alias("y0"),
        F.dayofmonth("o_orderdate").cast("bigint").alias("x1"), (F.col("o_orderkey") % 40).alias("y1"),
    )
    return files.line_cells(segments).select("o_orderkey", "x", "y")


# Polylines: a customer's orders are the vertices of a line that leaves the grid of 27 x 25 cells and comes back.
CTES["vertices"] = """
SELECT o_custkey AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq, (o_orderkey * 7 % 400) / 10e0 - 5e0 AS x,
       (o_orderkey * 11 % 350) / 10e0 - 5e0 AS y FROM orders"""
CTES["line_parts"] = """
SELECT line, seq, floor(least(greatest(x0 + t0 * dx, 0e0), 26e0) + 5e-1)::BIGINT AS x0, floor(least(greatest(y0 + t0 * dy, 0e0), 24e0) + 5e-1)::BIGINT AS y0,
       floor(least(greatest(x0 + t1 * dx, 0e0), 26e0) + 5e-1)::BIGINT AS x1, floor(least(greatest(y0 + t1 * dy, 0e0), 24e0) + 5e-1)::BIGINT AS y1,
       sum(CASE WHEN t0 > 0 OR seq = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY seq) - 1 AS part
FROM (SELECT *, greatest(0e0, CASE WHEN dx > 0 THEN (0e0 - x0) / dx WHEN dx < 0 THEN (26e0 - x0) / dx WHEN x0 < 0 OR x0 > 26 THEN 2e0 ELSE 0e0 END,
                         CASE WHEN dy > 0 THEN (0e0 - y0) / dy WHEN dy < 0 THEN (24e0 - y0) / dy WHEN y0 < 0 OR y0 > 24 THEN 2e0 ELSE 0e0 END) AS t0,
             least(1e0, CASE WHEN dx > 0 THEN (26e0 - x0) / dx WHEN dx < 0 THEN (0e0 - x0) / dx ELSE 1e0 END,
                   CASE WHEN dy > 0 THEN (24e0 - y0) / dy WHEN dy < 0 THEN (0e0 - y0) / dy ELSE 1e0 END) AS t1
      FROM (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM (SELECT line, seq, x AS x0, y AS y0, lead(x) OVER (PARTITION BY line ORDER BY seq) AS x1,
              lead(y) OVER (PARTITION BY line ORDER BY seq) AS y1 FROM vertices)) WHERE x1 IS NOT NULL) WHERE t0 <= t1"""


@query("src_shapefile_lines", """
SELECT DISTINCT line, part::BIGINT AS part, CAST(x0 + sign(x1 - x0) * least(greatest(k - greatest(ay - ax, 0), 0), ax) AS INTEGER) AS x,
       CAST(y0 + sign(y1 - y0) * least(greatest(k - greatest(ax - ay, 0), 0), ay) AS INTEGER) AS y
FROM (SELECT *, unnest(range(0, CASE WHEN ax > 0 AND ay > 0 THEN greatest(ax, ay) ELSE 0 END + 1)) AS k
      FROM (SELECT *, abs(x1 - x0) AS ax, abs(y1 - y0) AS ay FROM line_parts))""")
def src_shapefile_lines(w):
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    place = lambda factor, turn: (F.col("o_orderkey") * factor % turn) / 10.0 - 5.0
    vertices = w.table("orders").select(F.col("o_custkey").alias("line"), number.cast("bigint").alias("seq"), place(7, 400).alias("x"), place(11, 350).alias("y"))
    return polylines.polyline_cells(vertices, (27, 25))


def _stored(w):
    """Write the cluster tables once per session and read them back."""
    if not hasattr(w, "_stored_path"):
        w._stored_path = scratch(w, "clusters")
        d = w.detection
        sinks.write_clusters(w._stored_path, w.tracks.tracked, d.members, w.tracks.events)
    return files.read_clusters(w.spark, w._stored_path)


@query("src_cluster_read", """
SELECT m.scan, m.cluster, m.pid, m.y, m.x, i.id FROM members m JOIN ids i ON i.cluster = m.cluster""")
def src_cluster_read(w):
    clusters, members, _ = _stored(w)
    mapped = files.remap_members(members.drop("y", "x", "pid"), tb.GRID)
    return mapped.join(clusters.select("cluster", "id"), "cluster").select("scan", "cluster", "pid", "y", "x", "id")


@query("sink_clusters", """
SELECT scan, cluster, uuid, id, size, round(center_y, 6) AS center_y, round(mode_v, 6) AS mode_v, bbox_min_y, bbox_max_x, has_margin,
       round(d_y, 6) AS d_y FROM tracked""")
def sink_clusters(w):
    clusters, _, _ = _stored(w)
    return clusters.select(
        "scan", "cluster", "uuid", "id", "size", r("center_y", "center_y"), r("mode_v", "mode_v"), "bbox_min_y", "bbox_max_x", "has_margin",
        r("d_y", "d_y"),
    )


@query("sink_events", """
SELECT scan, kind, id, CAST(0 AS BIGINT) AS parts FROM simple_events
UNION ALL SELECT scan, 'merge', id, count(*) FROM merge_parts GROUP BY scan, id
UNION ALL SELECT scan, 'split', id, count(*) FROM split_parts GROUP BY scan, id""")
def sink_events(w):
    _, _, events = _stored(w)
    return events.select("scan", "kind", "id", F.size("related").cast("bigint").alias("parts"))


@query("sink_store", "SELECT scan, ts, y, x, CAST(v_raw * 2 AS INTEGER) AS v_raw, u_raw FROM cells")
def sink_store(w):
    path = scratch(w, "cells")
    sinks.write_cells(path, w.cells.withColumn("v_raw", F.col("v_raw") * 2))
    return w.spark.read.parquet(path).drop("scan_group")


@query("sink_add_time", "SELECT scan, y, x, ts, make_timestamp(ts * 1000000) AS time FROM (SELECT scan, y, x, ts + 60 AS ts FROM cells)")
def sink_add_time(w):
    timed = sinks.add_time(w.cells, F.col("ts") + 60).select("scan", "y", "x", "ts", "time")
    return timed.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("sink_minmax", """
SELECT 'v' AS var, CAST(min(v_raw) AS DOUBLE) AS valid_min, CAST(max(v_raw) AS DOUBLE) AS valid_max FROM cells WHERE v_raw <> 255
UNION ALL SELECT 'u', CAST(min(u_raw) AS DOUBLE), CAST(max(u_raw) AS DOUBLE) FROM cells""")
def sink_minmax(w):
    return sinks.variable_limits(w.cells, tb.VARIABLES)


@query("sink_copydims", "SELECT scan, gid, y * 2e0 + 5e-1 AS c_y, x * 2e0 + 5e-1 AS c_x FROM members")
def sink_copydims(w):
    lines = w.cells.select(F.explode(F.array(*[
        F.struct(F.lit(d).alias("dim"), F.col(d).alias("idx"), (F.col(d) * 2.0 + 0.5).alias("coord")) for d in tb.GRID.dims
    ])).alias("a")).select("a.*").distinct()
    return sinks.replace_axes(w.detection.members, lines, tb.GRID.dims).select("scan", "gid", "c_y", "c_x")


@query("sink_copy_dims_vars", "SELECT scan, y, x, v_raw AS v_copy, CAST(NULL AS INTEGER) AS u_empty FROM cells")
def sink_copy_dims_vars(w):
    return w.cells.select("scan", "y", "x", F.col("v_raw").alias("v_copy"), F.lit(None).cast("int").alias("u_empty"))
