"""Writers: cluster tables, statistics reports, the track dictionary and comparison exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.operators.featurespace import Variable
from skytrace.session import attach, store
from skytrace.sources.publish import publish


def write_clusters(path: str, clusters: DataFrame, members: DataFrame, events: DataFrame) -> None:
    """Cluster, member and event tables, published together. Members are the large table: partitioned by a bounded scan group, not by scan,
    so that a million scans do not make a million folders."""
    group = F.floor(F.col("scan") / 1000).cast("bigint").alias("scan_group")
    publish(path, {name: df.select("*", group) for name, df in (("clusters", clusters), ("members", members), ("events", events))}, ["scan_group"])


def write_cells(path: str, cells: DataFrame) -> None:
    group = F.floor(F.col("scan") / 1000).cast("bigint").alias("scan_group")
    cells.select("*", group).write.mode("overwrite").partitionBy("scan_group").parquet(path)


def add_time(cells: DataFrame, ts: Column) -> DataFrame:
    """Epoch seconds as ``ts`` and the derived timestamp as ``time``."""
    return cells.withColumn("ts", ts.cast("bigint")).withColumn("time", F.timestamp_seconds("ts"))


def variable_limits(cells: DataFrame, variables: list[Variable]) -> DataFrame:
    """Smallest and largest stored value per variable, fill values left out: (var, valid_min, valid_max)."""
    stacked = F.explode(
        F.array(*[
            F.struct(F.lit(v.name).alias("var"), F.when(
                F.lit(True) if v.fill_value is None else F.col(v.name + "_raw") != F.lit(v.fill_value),
                F.col(v.name + "_raw").cast("double")).alias("raw"))
            for v in variables
        ])
    )
    rows = cells.select(stacked.alias("r")).select("r.var", "r.raw")
    return rows.groupBy("var").agg(F.min("raw").alias("valid_min"), F.max("raw").alias("valid_max"))


def replace_axes(members: DataFrame, axis: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Coordinates of stored members replaced by those of a template axis (dim, idx, coord)."""
    axis = store(axis)
    for d in dims:
        line = axis.where(F.col("dim") == d).select(F.col("idx").cast("int").alias(d), F.col("coord").alias("_c"))
        members = attach(members, line, [d], "gid", "left", part_of=axis).withColumn("c_" + d, F.coalesce("_c", "c_" + d)).drop("_c")
    return members


DOCUMENT_STEPS = 10_000


def dictionary_rows(dict_clusters: DataFrame, names: list[str], exclude_degenerates: bool = True, steps: int = DOCUMENT_STEPS) -> DataFrame:
    """One JSON document per track and part: id, length, part, clusters in step order, min and max of the variables ``names``.

    Every track is told in parts of ``steps`` steps, numbered from 0 at its first step (a track has one cluster per step), so a document
    stays bounded; length, min and max always describe the whole track.
    """
    fields = [c for c in dict_clusters.columns if c != "id"]
    whole = dict_clusters.groupBy("id").agg(
        F.count("*").alias("length"), F.min("step").alias("_first"),
        F.array(*[F.min(F.get("min", F.lit(k))) for k in range(len(names))]).alias("min"),
        F.array(*[F.max(F.get("max", F.lit(k))) for k in range(len(names))]).alias("max"),
    )
    if exclude_degenerates:
        whole = whole.where("length > 1")
    # a long track's clusters meet one row here; they are combined per part, not per track
    parts = dict_clusters.select("id", F.struct(*fields).alias("c")).join(whole.select("id", "_first"), "id")
    parts = parts.withColumn("part", F.floor((F.col("c.step") - F.col("_first")) / steps))
    lists = parts.groupBy("id", "part").agg(F.array_sort(F.collect_list(F.struct("c.step", "c.uuid", "c"))).alias("_cs"))
    joined = lists.join(whole.drop("_first"), "id")
    doc = F.struct("id", "length", "part", F.transform("_cs", lambda s: s["c"]).alias("clusters"), "min", "max")
    return joined.select("id", "part", F.to_json(doc).alias("json"))


def write_dictionary(
    path: str, dict_clusters: DataFrame, nodes: DataFrame, links: DataFrame, dims: list[str], variables: list[str]
) -> None:
    """The track dictionary as a folder of JSON lines: ``header``, ``tracks``, ``nodes`` and ``links``.

    Written in parallel; one JSON document for everything would pass through a single task.
    """
    spark = dict_clusters.sparkSession
    count = dict_clusters.select("id").distinct().count()
    header = spark.createDataFrame([(dims, variables, count)], "spatial_range array<string>, value_range array<string>, number_of_tracks bigint")
    header.coalesce(1).write.mode("overwrite").json(f"{path}/header")
    dictionary_rows(dict_clusters, variables).select("json").write.mode("overwrite").text(f"{path}/tracks")
    nodes.select("uuid", "id", "size", "step").write.mode("overwrite").json(f"{path}/nodes")
    links.select("source", "target", "type", "id").write.mode("overwrite").json(f"{path}/links")


def histogram_lines(hist: DataFrame, last: float) -> DataFrame:
    """Report lines ``class,n``; the overflow row reads `` > last,n``."""
    label = lambda c: F.format_string("%d", c.cast("bigint"))
    line = F.when(F.col("class").isNull(), F.concat(F.lit(" > "), label(F.lit(last)), F.lit(","), F.col("n").cast("string"))).otherwise(
        F.concat(label(F.col("class")), F.lit(","), F.col("n").cast("string"))
    )
    return hist.select(F.coalesce("class", F.lit(float("inf"))).alias("pos"), line.alias("line"))


def value_lines(dist: DataFrame, value: str) -> DataFrame:
    """Plot file lines ``value  n``."""
    return dist.select(F.concat(F.col(value).cast("string"), F.lit("  "), F.col("n").cast("string")).alias("line"))


def write_lines(path: str, lines: DataFrame) -> None:
    """Ordered report lines. A histogram has a fixed number of classes, so one file is fine."""
    lines.orderBy("pos").select("line").coalesce(1).write.mode("overwrite").text(path)


def tic_objects(clusters: DataFrame, variable: str, y_dim: str = "y", x_dim: str = "x") -> DataFrame:
    """Object table of the tracking intercomparison: 12 columns, centre and box in (x, y), median as the mean value."""
    return clusters.select(
        (F.col("step").cast("bigint") + 1).alias("timestep"), F.col("uuid").alias("id"),
        F.col("center_" + x_dim).alias("centerx"), F.col("center_" + y_dim).alias("centery"), F.col("size").alias("volume"),
        F.col("bbox_min_" + x_dim).alias("boxxmin"), F.col("bbox_max_" + x_dim).alias("boxxmax"),
        F.col("bbox_min_" + y_dim).alias("boxymin"), F.col("bbox_max_" + y_dim).alias("boxymax"),
        F.col("median_" + variable).alias("lwpmean"), F.col("min_" + variable).alias("lwpmin"), F.col("max_" + variable).alias("lwpmax"),
    )


def tic_tracks(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Successor table of the intercomparison; the weight is always 0."""
    source = nodes.select(F.col("uuid").alias("source"), "step")
    return links.join(source, "source").select(
        (F.col("step") + 1).alias("timestep"), F.col("source").alias("idstep1"), F.col("target").alias("idstep2"),
        F.lit(0).cast("bigint").alias("weight"),
    )


def write_tic(path: str, objects: DataFrame, tracks: DataFrame) -> None:
    objects.write.mode("overwrite").option("sep", ";").option("header", True).csv(f"{path}/objects")
    tracks.write.mode("overwrite").option("sep", ";").option("header", True).csv(f"{path}/tracks")
