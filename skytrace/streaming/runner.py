"""Structured Streaming front end: scans that land in a folder are detected and tracked batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from skytrace.operators.featurespace import Variable
from skytrace.params import DetectionParams, Grid, TrackingParams
from skytrace.plans.incremental import advance


def cell_schema(grid: Grid, variables: list[Variable]) -> str:
    dims = ", ".join(f"{d} int" for d in grid.dims)
    return f"scan bigint, ts bigint, {dims}, " + ", ".join(f"{v.name}_raw double" for v in variables)


def start(
    spark: SparkSession,
    source: str,
    output: str,
    grid: Grid,
    variables: list[Variable],
    detection: DetectionParams,
    tracking: TrackingParams,
    files_per_batch: int = 64,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Follow a folder of cell files; one file holds whole scans.

    Files are taken oldest first. A repeated batch overwrites its own output, so results are exactly-once. Scans that
    arrive after a later one was processed are rejected by the time gate, as are gaps above the maximum time.
    """
    stream = (
        spark.readStream.schema(cell_schema(grid, variables)).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    )

    def process(batch: DataFrame, number: int) -> None:
        cells = batch.persist()
        try:
            if not cells.isEmpty():
                advance(spark, cells, output, number, grid, variables, detection, tracking)
        finally:
            cells.unpersist()

    return (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint or f"{output}/_stream")
        .trigger(availableNow=True).start()
    )
