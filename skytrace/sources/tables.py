"""Gridded scans derived from relational tables: one scan per supplier, quantity and season as axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrace.operators.featurespace import Variable
from skytrace.params import DetectionParams, Grid, TrackingParams

GRID = Grid(("y", "x"), (25, 27), (1.0, 1.0), (0.0, 0.0), ("km", "km"))
V = Variable("v", scale_factor=0.5, valid_min=0.0, valid_max=60.0, fill_value=255.0)
U = Variable("u", valid_min=0.0, valid_max=104.0)
VARIABLES = [V, U]
LIMITS = {x.name: x.limits for x in VARIABLES}

DETECTION = DetectionParams(
    variables=("v", "u"), lower={"v": 1.5}, upper={"v": 28.0}, kernel="gauss", ranges=(2.0, 2.0, 10.0, 50.0), min_cluster_size=3
)
TRACKING = TrackingParams(continuation_threshold=0.25)

GRID_3D = Grid(("z", "y", "x"), (7, 25, 27), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0), ("km", "km", "km"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_time(scan: F.Column) -> F.Column:
    """One scan a minute, with a long gap after every 25 scans."""
    return (scan * 60 + F.floor(scan / 25) * 1000).cast("bigint")


def _axes(lineitem: DataFrame) -> dict[str, F.Column]:
    return {
        "scan": F.col("l_suppkey"),
        "y": F.floor((F.col("l_quantity") - 1) / 2).cast("int"),
        "x": F.floor((F.dayofyear("l_shipdate") - 1) / 14).cast("int"),
    }


def _values() -> list[F.Column]:
    discount = F.sum(F.round(F.col("l_discount") * 100).cast("bigint"))
    return [
        F.when(F.max("l_tax") >= 0.08, 255).otherwise(F.least(discount, F.lit(60))).cast("int").alias("v_raw"),
        F.floor(F.max("l_extendedprice") / 1000).cast("int").alias("u_raw"),
    ]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2-D scans with two packed variables; cells with a taxed-out line hold the fill value."""
    axes = _axes(None)
    grouped = table(spark, sf_dir, "lineitem").groupBy(*[c.alias(n) for n, c in axes.items()]).agg(*_values())
    return grouped.select("scan", scan_time(F.col("scan")).alias("ts"), "y", "x", "v_raw", "u_raw")


def cells_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scans with the line number as a third, slowest axis."""
    axes = {**_axes(None), "z": (F.col("l_linenumber") - 1).cast("int")}
    grouped = table(spark, sf_dir, "lineitem").groupBy(*[c.alias(n) for n, c in axes.items()]).agg(*_values())
    return grouped.select("scan", scan_time(F.col("scan")).alias("ts"), "z", "y", "x", "v_raw", "u_raw")
