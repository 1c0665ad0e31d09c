"""File-level sources: names and times, foreign cluster records, radar composites, gridded files, stored clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrace.operators.ordering import number_rows
from skytrace.session import counted, cut
from skytrace.sources import radar
from skytrace.sources.publish import latest

# Known file name forms as (prefix, digits pattern, time format); the first matching prefix decides.
NAME_FORMATS = {
    "radolan": ("raa01-rx_10000-", r"(\d{10})", "yyMMddHHmm"),
    "oase-2d": ("oase-", r"(\d{8}t\d{4})z", "yyyyMMdd't'HHmm"),
    "oase-3d": ("herz-oase-", r"(\d{8}t\d{4})", "yyyyMMdd't'HHmm"),
    "herz-tb4": ("tb_", r"(\d{10})", "yyyyMMddHH"),
}


def timestamp_from_name(name: Column, form: str | None = None) -> Column:
    """Epoch seconds from a file name of a known form; NULL if no form fits."""
    out = F.lit(None).cast("bigint")
    for key, (prefix, digits, pattern) in NAME_FORMATS.items():
        if form is None or form == key:
            text = F.regexp_extract(name, "^" + prefix + digits, 1)
            out = F.coalesce(out, F.when(text != "", F.unix_timestamp(F.try_to_timestamp(F.concat(text, F.lit("+0000")), F.lit(pattern + "Z")))))
    return out


def pick_time(times: Column, time_index: int, name: Column | None = None) -> Column:
    """Time of a scan from a file's time axis: 0 without times, the first without index, else the indexed one
    (0 beyond the end). The axis of simulation files ``rico.out.xy.*`` counts days."""
    position = 0 if time_index < 0 else time_index
    picked = F.coalesce(F.get(times, F.lit(position)), F.lit(0.0))
    if name is not None:
        picked = F.when(F.contains(name, F.lit("rico.out.xy.")), F.round(picked * 86400.0)).otherwise(picked)
    return picked.cast("bigint")


def directory_steps(names: DataFrame) -> DataFrame:
    """Files in name order with their step, starting at 0. ``names(name)``, unique."""
    return number_rows(cut(names.select("name").distinct()), "name", "step").withColumn("step", F.col("step") - 1)


def list_directory(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """File names below a directory, without reading the files' content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path")


def list_folders(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(name): the distinct values of the folder level ``<key>=<value>`` below a path that hold files."""
    found = list_directory(spark, path, "*").select(F.regexp_extract("path", f"/{key}=([^/]+)/", 1).alias("name"))
    return found.where("name <> ''").distinct()


def common_prefix(names: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Longest common prefix of all names: that of the smallest and the largest."""
    ends = names.groupBy(*(by or [])).agg(F.min("name").alias("lo"), F.max("name").alias("hi"))
    shared = F.filter(
        F.sequence(F.lit(1), F.length("lo")),
        lambda i: F.substr(F.col("lo"), F.lit(1), i) == F.substr(F.col("hi"), F.lit(1), i),
    )
    length = F.coalesce(F.array_max(shared), F.lit(0))
    return ends.select(*(by or []), F.substr(F.col("lo"), F.lit(1), length).alias("prefix"))


# Fields of a foreign cluster record, in file order.
KONRAD_FIELDS = (
    "year", "month", "day", "hour", "minute", "id", "cell_status", "center_y", "center_x", "num_core_pixels", "num_pixels",
    "direction_deg", "lifetime", "hail_warning", "pixel_per_hour", "y_min", "x_min", "y_max", "x_max",
)
KONRAD_REAL = {"center_y", "center_x", "direction_deg", "pixel_per_hour", "y_min", "x_min", "y_max", "x_max"}


def konrad_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Whitespace-separated records with their epoch time; :func:`konrad_rejects` has the lines that do not hold all fields."""
    # the one-element explode keeps the optimizer from repeating the split for every field and filter above it
    parts = F.explode(F.array(F.split(F.trim(F.col(column)), r"\s+")))
    rows = lines.select(parts.alias("_p")).where(F.size("_p") >= len(KONRAD_FIELDS))
    typed = [
        F.get("_p", F.lit(i)).try_cast("double" if f in KONRAD_REAL else "bigint").alias(f) for i, f in enumerate(KONRAD_FIELDS)
    ]
    return rows.select(*typed).withColumn("ts", konrad_time())


def konrad_rejects(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines with fewer fields than a record, and how many they have."""
    fields = F.size(F.filter(F.split(F.trim(F.col(column)), r"\s+"), lambda f: f != ""))
    return lines.withColumn("fields", F.coalesce(fields, F.lit(0))).where(F.col("fields") < len(KONRAD_FIELDS))


def konrad_time() -> Column:
    """Two-digit years above 50 belong to the last century; an impossible date is NULL."""
    year = F.when(F.col("year") > 50, F.col("year") + 1900).otherwise(F.col("year") + 2000)
    whole = [c.cast("int") for c in (year, F.col("month"), F.col("day"), F.col("hour"), F.col("minute"))]
    return F.unix_timestamp(F.try_make_timestamp(*whole, F.lit(0), F.lit("UTC")))


def read_konrad(spark: SparkSession, path: str) -> DataFrame:
    return konrad_records(spark.read.text(path))


# Fixed value: the least of one-byte reflectivities.
RX_MIN_DBZ = radar.OFFSET


def radar_threshold(value: Column, threshold: float, minimum: float = RX_MIN_DBZ) -> Column:
    """Values below the threshold become the minimum."""
    return F.when(value >= F.lit(float(threshold)), value).otherwise(F.lit(float(minimum)))


def rvp6_byte(value: Column) -> Column:
    return F.round((value - F.lit(radar.OFFSET)) / F.lit(radar.SCALE)).cast("int")


def rvp6_value(byte: Column) -> Column:
    return byte * F.lit(radar.SCALE) + F.lit(radar.OFFSET)


def radar_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(name, reason) of the files that :func:`read_radar_composites` leaves out: other products, bad headers, missing pixels."""
    return radar.rejects(radar.composite_files(spark, path), radar.ONE_BYTE)


def read_radar_composites(spark: SparkSession, path: str, threshold: float | None = None) -> DataFrame:
    """One-byte radar composites as cells: (scan, ts, y, x, rx_raw); missing and clutter pixels keep the fill value."""
    found = radar.pixels(radar.composite_files(spark, path), radar.ONE_BYTE)
    raw = F.when(F.col("missing") | F.col("clutter"), F.lit(radar.BYTE_MISSING))
    if threshold is not None:
        raw = raw.when(F.col("value") < F.lit(float(threshold)), F.lit(0))
    return found.select(F.col("ts").alias("scan"), "ts", "y", "x", raw.otherwise(F.col("raw")).alias("rx_raw"))


def read_clusters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored (clusters, members, events) tables: the newest published version, or those of an incremental run. They are counted: few bytes may hold many rows."""
    at = latest(spark, path)
    folder = path if at is None else f"{path}/versions/{at[1]}"
    return tuple(counted(spark.read.parquet(f"{folder}/{t}")) for t in ("clusters", "members", "events"))


def remap_members(members: DataFrame, grid) -> DataFrame:
    """Grid indices of stored members from their coordinates; members outside the grid are dropped."""
    from skytrace.operators.featurespace import linear_index, reverse_lookup

    found = members.withColumns({d: reverse_lookup(F.col("c_" + d), grid, d) for d in grid.dims})
    inside = found.dropna(subset=list(grid.dims))
    return inside.withColumn("pid", linear_index(grid))


TOPOGRAPHY_LEVEL_KM = 0.25


def topography_levels(heights: DataFrame, levels: int) -> DataFrame:
    """Fill a terrain column: every level up to ceil(height / 0.25 km). ``heights(y, x, height_m)``."""
    top = F.ceil(F.col("height_m") / 1000.0 / TOPOGRAPHY_LEVEL_KM).cast("int")
    top = F.greatest(F.least(top, F.lit(levels - 1)), F.lit(0))
    return heights.select("*", F.explode(F.sequence(F.lit(0), top)).alias("z"))


def line_cells(segments: DataFrame) -> DataFrame:
    """Cells of grid line segments (x0, y0) -> (x1, y1): walk the longer axis until both distances are equal, then
    diagonally. A segment along an axis marks its start only."""
    ax, ay = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    steps = F.when((ax > 0) & (ay > 0), F.greatest(ax, ay)).otherwise(F.lit(0))
    walked = segments.withColumn("_k", F.explode(F.sequence(F.lit(0), steps.cast("int"))))
    along = lambda own, other: F.least(F.greatest(F.col("_k") - F.greatest(other - own, F.lit(0)), F.lit(0)), own)
    x = F.col("x0") + F.signum(F.col("x1") - F.col("x0")) * along(ax, ay)
    y = F.col("y0") + F.signum(F.col("y1") - F.col("y0")) * along(ay, ax)
    return walked.withColumns({"x": x.cast("int"), "y": y.cast("int")}).drop("_k")
