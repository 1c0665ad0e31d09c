"""Run detection and tracking on scans as they arrive, continuing from stored results.

Results live in ``<output>/{clusters,members,events,scans,state}/batch=<n>/part=<p>``. Writing a batch again replaces it, so a batch
that failed half way can be repeated. ``scans`` lists every processed scan, also those without clusters, and ``state`` holds one row per part: the
last scan and the highest numbers given so far. The next batch reads that row and the one scan it names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from skytrace.operators import clustering, featurespace, tracking
from skytrace.operators.featurespace import Variable
from skytrace.params import DetectionParams, Grid, TrackingParams
from skytrace.plans.detection import describe, detect
from skytrace.plans.tracking import Tracks, track
from skytrace.session import cut

TABLES = ("clusters", "members", "events")


@dataclass
class State:
    """The last scan stored before a batch."""

    scan: int
    ts: int
    highest_id: int
    highest_uuid: int
    clusters: DataFrame
    members: DataFrame
    batch: int


def load_state(spark: SparkSession, output: str, batch: int) -> State | None:
    known = stored(spark, f"{output}/state")
    last = None if known is None else known.where(F.col("batch") < batch).orderBy(F.desc("batch"), F.desc("part")).first()
    if last is None:
        return None
    pick = lambda name: cut(
        spark.read.parquet(f"{output}/{name}").where((F.col("batch") == last["at_batch"]) & (F.col("scan") == last["scan"])).drop("batch", "part")
    )
    return State(last["scan"], last["ts"], last["highest_id"], last["highest_uuid"], pick("clusters"), pick("members"), last["at_batch"])


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or None if nothing was ever stored there; any other failure to read it is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def advance(
    spark: SparkSession,
    cells: DataFrame,
    output: str,
    batch: int,
    grid: Grid,
    variables: list[Variable],
    detection: DetectionParams,
    tracking_params: TrackingParams,
) -> None:
    """Process the scans of one batch. Scans at or before the last stored time are rejected."""
    state = load_state(spark, output, batch)
    if state is not None:
        cells = cells.where(F.col("ts") > state.ts)
    if not (detection.postprocess_with_previous or tracking_params.use_displacement_vectors):
        found = detect(cells, grid, variables, detection)
        _one_step(spark, cells, found.members, found.clusters, output, batch, 0, state, grid, variables, detection, tracking_params)
        return
    # both options feed each scan's clusters into the next: one detection over all scans, then cluster tables in time order
    cells = cut(cells)
    found = detect(cells, grid, variables, detection)
    scans = cut(cells.select("scan", "ts").distinct())
    for part, row in enumerate(scans.select("ts").distinct().orderBy("ts").toLocalIterator()):
        now = F.broadcast(scans.where(F.col("ts") == row["ts"]))
        step = (cells.where(F.col("ts") == row["ts"]), *(df.join(now.select("scan"), "scan", "left_semi") for df in (found.members, found.clusters)))
        state = _one_step(spark, *step, output, batch, part, state, grid, variables, detection, tracking_params)


def _one_step(spark, cells, members, clusters, output, batch, part, state, grid, variables, detection, tracking_params) -> State | None:
    if state is not None:
        before = clusters.agg(F.min("uuid")).first()[0] or 1
        clusters = clusters.withColumn("uuid", F.col("uuid") - F.lit(before - 1) + F.lit(state.highest_uuid))
    previous_members, previous_clusters = (None, None) if state is None else (state.members, state.clusters)
    if state is not None and detection.postprocess_with_previous:
        members, clusters = consolidate(members, clusters, state, cells, grid, variables)
    if state is not None and tracking_params.use_displacement_vectors:
        previous_members = tracking.advect(state.members, state.clusters, grid)
        previous_clusters = state.clusters.withColumns(
            {"center_" + d: F.col("center_" + d) + F.coalesce("d_" + d, F.lit(0.0)) for d in grid.dims}
        )
    scans = cut(cells.select("scan", "ts").distinct())
    result = _track_after(
        previous_clusters, previous_members, state, clusters, members, scans, grid, tracking_params,
        {v.name: v.limits for v in variables},
    )
    tracked, events = result.tracked, result.events
    if state is not None:
        tracked, events = (df.where(F.col("scan") != state.scan) for df in (tracked, events))
    stored_members = members.drop("w", *[c for c in members.columns if c.startswith(("s_", "g_"))])
    for name, df in zip(TABLES, (tracked, stored_members, events)):
        df.write.mode("overwrite").parquet(f"{output}/{name}/batch={batch}/part={part}")
    scans.write.mode("overwrite").parquet(f"{output}/scans/batch={batch}/part={part}")
    at = scans.agg(F.max(F.struct("ts", "scan")).alias("at")).first()["at"]
    if at is None:
        return state
    given = tracked.agg(F.max("id").alias("id"), F.max("uuid").alias("uuid")).first()
    highest = lambda now, before: max(now or 0, before or 0)
    last_of = lambda df: cut(df.where(F.col("scan") == at["scan"]))
    new = State(
        at["scan"], at["ts"], highest(given["id"], state and state.highest_id), highest(given["uuid"], state and state.highest_uuid),
        last_of(tracked), last_of(members), batch,
    )
    row = (new.scan, new.ts, new.highest_id, new.highest_uuid, new.batch)
    table = spark.createDataFrame([row], "scan bigint, ts bigint, highest_id bigint, highest_uuid bigint, at_batch int")
    table.coalesce(1).write.mode("overwrite").parquet(f"{output}/state/batch={batch}/part={part}")
    return new


def _track_after(previous_clusters, previous_members, state, clusters, members, scans, grid, params, limits) -> Tracks:
    if state is None:
        return track(clusters, members, scans, grid, params, limits)
    before = previous_clusters.sparkSession.createDataFrame([(state.scan, state.ts)], "scan bigint, ts bigint")
    columns = [c for c in clusters.columns]
    needed = [c for c in members.columns if c in previous_members.columns]
    everything = cut(clusters.unionByName(previous_clusters.select(*columns)))
    all_members = cut(members.select(*needed).unionByName(previous_members.select(*needed)))
    return track(
        everything, all_members, scans.unionByName(before), grid, params, limits,
        highest_id=state.highest_id, known=previous_clusters.select("cluster", "id"),
    )


def consolidate(members, clusters, state: State, cells, grid: Grid, variables: list[Variable]):
    """Merge current clusters that are parts of one previous cluster; the merged mode is the mean of the modes. A cluster held by two previous
    ones joins both, and its points are members of both."""
    names = [v.name for v in variables]
    modes = ["mode_" + n for n in names]
    cover = clustering.cell_cover(
        members.select(F.lit(0).alias("pair"), "pid", F.col("cluster").alias("n")),
        state.members.select(F.lit(0).alias("pair"), "pid", F.col("cluster").alias("m")),
    )
    mapping = cut(clustering.consolidate_with_previous(cover, clusters, modes))
    if mapping.isEmpty():
        return members, clusters
    groups = cut(clustering.consolidated_groups(mapping, members, modes))
    to = groups.select(F.col("n").alias("cluster"), F.col("label").alias("_to"))
    merged = members.join(to, "cluster", "left").withColumn("cluster", F.coalesce("_to", "cluster")).drop("_to")
    merged = cut(merged.dropDuplicates(["cluster", "gid"]).select(*members.columns))
    blocked = cells.where(featurespace.off_limits(variables)).select("scan", *grid.dims)
    table = describe(merged, grid, names, blocked, first_uuid=state.highest_uuid)
    mean_modes = groups.groupBy(F.col("label").alias("cluster")).agg(*[F.first(m).alias("_" + m) for m in modes])
    table = table.join(mean_modes, "cluster", "left")
    return merged, cut(table.withColumns({m: F.coalesce("_" + m, m) for m in modes}).drop(*["_" + m for m in modes]))
