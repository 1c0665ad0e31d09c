"""Tables that belong together, published at once.

A writer puts every table of a version into a fresh folder and then appends one row to the manifest; that row is the commit. Readers take the
newest row of the manifest, so they see a whole version or the one before, whatever fails in between. Folders of versions that
were never published, or are no longer wanted, fall under the storage's retention rule.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

MANIFEST = "published"


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """(number, version, tables) of all published versions; None if there are none."""
    try:
        return spark.read.parquet(f"{path}/{MANIFEST}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def latest(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """Number and folder of the newest version; of two that were published under one number, the greater name."""
    known = manifest(spark, path)
    row = None if known is None else known.orderBy(F.desc("number"), F.desc("version")).first()
    return None if row is None else (row["number"], row["version"])


def publish(path: str, tables: dict[str, DataFrame], partition_by: list[str] | None = None) -> str:
    """Write all tables, then make them the newest version; returns its name. Tables may be derived from an older version."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.partitionBy(*(partition_by or [])).parquet(f"{path}/versions/{version}/{name}")
    before = latest(spark, path)
    row = spark.createDataFrame([((before[0] if before else 0) + 1, version, [*tables])], "number long, version string, tables array<string>")
    row.coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")
    return version


def read(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table of the newest version; None if nothing was published."""
    at = latest(spark, path)
    return None if at is None else spark.read.parquet(f"{path}/versions/{at[1]}/{name}")
