"""Track dictionary, track graph and the distributions over tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytrace.functions.vectors import vec
from skytrace.params import Grid
from skytrace.session import attach, cut
from skytrace.session import keep as store

CONTINUE, SPLIT, MERGE = 0, 1, 2


def nodes(clusters: DataFrame) -> DataFrame:
    """One graph node per cluster. ``clusters`` carries uuid, id, step, size."""
    return clusters.select("uuid", "id", F.col("step").cast("bigint").alias("step"), "size")


def links(node_table: DataFrame, tracked: DataFrame, merge_events: DataFrame, split_events: DataFrame) -> DataFrame:
    """Graph edges from one step to the next.

    ``tracked(step, id)``; events ``(step, id, related ARRAY<BIGINT>)``. Continue: same id one step before. Split: the
    splitting id one step before leads to each part. Merge: each merged id one step before leads to the result.
    A link carries its source's id, a merge link its target's.
    """
    here = node_table.select("uuid", "id", "step")
    before = here.select(F.col("uuid").alias("source"), F.col("id").alias("source_id"), (F.col("step") + 1).alias("step"))
    target = here.select(F.col("uuid").alias("target"), F.col("id").alias("target_id"), "step")

    def edge(pairs: DataFrame, kind: int, carried: str) -> DataFrame:
        joined = pairs.join(before, ["step", "source_id"]).join(target, ["step", "target_id"])
        return joined.select("source", "target", F.lit(kind).alias("type"), F.col(carried).alias("id"))

    kept = tracked.select("step", F.col("id").alias("source_id"), F.col("id").alias("target_id"))
    divided = split_events.select("step", F.col("id").alias("source_id"), F.explode("related").alias("target_id"))
    united = merge_events.select("step", F.explode("related").alias("source_id"), F.col("id").alias("target_id"))
    all_links = (
        edge(kept, CONTINUE, "source_id")
        .unionByName(edge(divided, SPLIT, "source_id"))
        .unionByName(edge(united, MERGE, "target_id"))
    )
    return all_links.dropDuplicates(["source", "target", "type"])


def track_lengths(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("id").agg(F.count("*").alias("length"))


def degenerates(lengths: DataFrame) -> DataFrame:
    """Number of tracks and of tracks of length one."""
    return lengths.agg(F.count("*").alias("tracks"), F.count_if(F.col("length") == 1).alias("degenerates"))


def without_degenerates(clusters: DataFrame, lengths: DataFrame) -> DataFrame:
    """Clusters of tracks longer than one."""
    kept = cut(lengths.where("length > 1").select("id"))
    return attach(clusters, kept, ["id"], "uuid").select(*clusters.columns)


def class_limit(value: Column, classes: tuple[float, ...]) -> Column:
    """Upper limit of the first class with value <= limit; NULL above the last one."""
    limits = F.lit([float(c) for c in classes])
    return F.get(F.filter(limits, lambda c: value <= c), F.lit(0))


def distribution(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("n"))


def class_histogram(df: DataFrame, value: str, classes: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """(class, n) for every class, empty ones included, and one overflow row (class NULL) if needed."""
    by = by or []
    counted = df.groupBy(*by, class_limit(F.col(value), classes).alias("class")).agg(F.count("*").alias("n"))
    every = F.explode(F.lit([float(c) for c in classes])).alias("class")
    base = (df.select(*by).distinct() if by else df.sparkSession.range(1)).select(*by, every, F.lit(0).cast("bigint").alias("n"))
    return base.unionByName(counted).groupBy(*by, "class").agg(F.sum("n").alias("n"))


def weighted_average(dist: DataFrame, value: str, ignore_one: bool = True) -> DataFrame:
    """Mean of a distribution, the class 1 left out by default."""
    kept = dist.where(F.col(value) != 1) if ignore_one else dist
    mean = F.try_divide(F.sum(F.col(value) * F.col("n")).cast("double"), F.sum("n"))
    return kept.agg(mean.alias("average"), F.max(value).alias("largest"))


def speeds(clusters: DataFrame, grid: Grid) -> DataFrame:
    """Speed in m/s of every cluster with a displacement. ``clusters``: uuid, id, dt, d_<dim> (NULL = none)."""
    d2 = F.lit(0.0)
    for d, f in zip(grid.dims, grid.meters):
        m = F.col("d_" + d) * F.lit(f)
        d2 = d2 + m * m
    return clusters.withColumn("speed", F.sqrt(d2) / F.col("dt")).where("speed > 0").select("uuid", "id", "speed")


# Polar stereographic grid of the national composite (km, degrees).
EARTH_RADIUS_KM = 6370.04
TRUE_LATITUDE = 60.0
CENTRAL_MERIDIAN = 10.0


def to_geographic(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees of a polar stereographic point (km, y axis towards the pole negative)."""
    k = EARTH_RADIUS_KM * (1.0 + _sin_deg(TRUE_LATITUDE))
    lon = F.degrees(F.atan2(x, -y)) + F.lit(CENTRAL_MERIDIAN)
    r2 = x * x + y * y
    return F.degrees(F.asin((F.lit(k * k) - r2) / (F.lit(k * k) + r2))), lon


def to_stereographic(lat: Column, lon: Column) -> tuple[Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon - F.lit(CENTRAL_MERIDIAN))
    m = F.lit(EARTH_RADIUS_KM * (1.0 + _sin_deg(TRUE_LATITUDE))) / (F.lit(1.0) + F.sin(phi))
    return m * F.cos(phi) * F.sin(lam), -(m * F.cos(phi) * F.cos(lam))


def _sin_deg(v: float) -> float:
    import math

    return math.sin(math.radians(v))


def directions(clusters: DataFrame, x_dim: str, y_dim: str, origin: tuple[float, float]) -> DataFrame:
    """Direction of motion in degrees clockwise from true north.

    The cluster centre plus ``origin`` (x, y in km) gives the point on the projection plane; north there is the
    direction to the pole, so the grid angle is corrected by the local meridian's angle.
    """
    x, y = F.col("center_" + x_dim) + origin[0], F.col("center_" + y_dim) + origin[1]
    meridian = F.degrees(F.atan2(x, -y))
    heading = F.degrees(F.atan2(F.col("d_" + x_dim), F.col("d_" + y_dim)))
    angle = (heading + meridian + 720.0) % 360.0
    moving = clusters.where(f"d_{x_dim} <> 0 OR d_{y_dim} <> 0")
    return moving.select("uuid", "id", angle.alias("direction"))


def cumulated(members: DataFrame, names: list[str]) -> DataFrame:
    """Per track and cell: visits and summed values. ``members``: id, pid, values."""
    return members.groupBy("id", "pid").agg(F.count("*").alias("visits"), *[F.sum(n).alias("sum_" + n) for n in names])


def cumulated_sizes(members: DataFrame) -> DataFrame:
    """Number of different cells each track ever covered (two-step, so a long track is combined map-side)."""
    return members.select("id", "pid").distinct().groupBy("id").agg(F.count("*").alias("cells"))


def track_ranges(clusters: DataFrame, names: list[str]) -> DataFrame:
    aggs = [f(f"{s}_{n}").alias(f"{s}_{n}") for n in names for f, s in ((F.min, "min"), (F.max, "max"))]
    return clusters.groupBy("id").agg(F.count("*").alias("length"), *aggs)


def dictionary_clusters(clusters: DataFrame, grid: Grid, names: list[str]) -> DataFrame:
    """One row per cluster in the field names of the track dictionary."""
    return clusters.select(
        "id", "size", "uuid", F.col("source").alias("sourcefile"),
        vec(*["center_" + d for d in grid.dims]).alias("geometrical_center"),
        vec(*["center_" + d for d in grid.dims], *["mode_" + n for n in names]).alias("mode"),
        vec(*["min_" + n for n in names]).alias("min"),
        vec(*["max_" + n for n in names]).alias("max"),
        vec(*["median_" + n for n in names]).alias("median"),
        F.col("step").cast("bigint").alias("step"), F.col("ts").alias("timestamp"),
        vec(*["bbox_min_" + d for d in grid.dims]).alias("bounding_box_min"),
        vec(*["bbox_max_" + d for d in grid.dims]).alias("bounding_box_max"),
        F.col("has_margin").alias("has_margin_points"),
    )


def track_filter(clusters: DataFrame, lengths: DataFrame, minimum: int | None = None, ids: list[int] | None = None) -> DataFrame:
    """Clusters of tracks of at least a length and/or of given ids."""
    out = clusters
    if minimum is not None:
        kept = cut(lengths.where(F.col("length") >= minimum).select("id"))
        out = attach(out, kept, ["id"], "uuid").select(*clusters.columns)
    return out.where(F.col("id").isin(ids)) if ids is not None else out


def length_index(lengths: DataFrame) -> DataFrame:
    """Different track lengths with the number of tracks and the smallest and largest id of each."""
    return lengths.groupBy("length").agg(F.count("*").alias("tracks"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def linked_nodes(link_table: DataFrame, roots: DataFrame, max_level: int = 1) -> DataFrame:
    """Nodes reachable from ``roots(root, uuid)``: Continue links are free, Split and Merge links cost one level, and nodes
    above ``max_level`` are kept but not expanded. Returns (root, uuid, level) with the smallest level.

    Continue links are one to one, so they form chains. These are contracted first (by pointer doubling); the walk then takes one round per level over
    chains, whatever their length, and chains are expanded once. Nodes one level further are added singly.
    """
    from skytrace.operators.tracking import resolve_ids

    free = link_table.where(F.col("type") == CONTINUE).select(F.col("target").alias("n"), F.col("source").alias("m"))
    ends = link_table.select(F.col("source").alias("cluster")).union(link_table.select("target")).union(roots.select("uuid"))
    nodes = store(ends.distinct())
    chains = store(resolve_ids(nodes, free, nodes.withColumn("new_id", F.col("cluster"))).select(F.col("cluster").alias("uuid"), F.col("id").alias("chain")))
    paid = link_table.where(F.col("type") != CONTINUE)
    paid = paid.select(F.col("source").alias("uuid"), F.col("target").alias("other")).union(paid.select("target", "source")).distinct()
    far = chains.select(F.col("uuid").alias("other"), F.col("chain").alias("to"))
    paid = store(paid.join(chains, "uuid").join(far, "other").select("chain", "other", "to").distinct())
    best = frontier = store(roots.join(chains, "uuid").select("root", "chain", F.lit(0).alias("level")).distinct())
    for level in range(1, max_level + 1):
        reached = frontier.join(paid, "chain").select("root", F.col("to").alias("chain")).distinct()
        frontier = store(reached.join(best.hint("merge"), ["root", "chain"], "left_anti").withColumn("level", F.lit(level)))
        best = best.unionByName(frontier)
        if frontier.isEmpty():
            break
    inside = store(best.join(chains, "chain").select("root", "uuid", "level"))
    rim = frontier.join(paid, "chain").select("root", F.col("other").alias("uuid")).distinct()
    return inside.unionByName(rim.join(inside, ["root", "uuid"], "left_anti").withColumn("level", F.lit(max_level + 1)))


def previous_in_time(df: DataFrame, key: str, order: str, columns: list[str], width: int = 86_400) -> DataFrame:
    """LAG of ``columns`` along ``order`` per key, as ``prev_<column>``, without one task per key.

    Rows are cut into time buckets; only the first row of a bucket asks for the last row of the bucket before,
    and that table has one row per key and bucket.
    """
    ranked = df.withColumn("_bucket", F.floor(F.col(order) / width))
    inside = Window.partitionBy(key, "_bucket").orderBy(order, *columns)
    ranked = ranked.withColumn("_prev", F.lag(F.struct(*columns)).over(inside))
    last = ranked.groupBy(key, "_bucket").agg(F.max_by(F.struct(*columns), F.struct(order, *columns)).alias("_last"))
    across = Window.partitionBy(key).orderBy("_bucket")
    carried = last.select(key, "_bucket", F.lag("_last").over(across).alias("_carried"))
    joined = ranked.join(carried, [key, "_bucket"])
    value = F.coalesce("_prev", "_carried")
    return joined.select(*df.columns, *[value[c].alias("prev_" + c) for c in columns])


def konrad_speeds(records: DataFrame) -> DataFrame:
    """Speed in m/s between successive records of a foreign track. ``records``: id, ts, x_km, y_km."""
    step = previous_in_time(records, "id", "ts", ["ts", "x_km", "y_km"])
    dx, dy = F.col("x_km") - F.col("prev_x_km"), F.col("y_km") - F.col("prev_y_km")
    distance = F.sqrt(dx * dx + dy * dy) * 1000.0
    dt = (F.col("ts") - F.col("prev_ts")).cast("double")
    return step.withColumn("speed", F.try_divide(distance, dt)).where("speed IS NOT NULL")
