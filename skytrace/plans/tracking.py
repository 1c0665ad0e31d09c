"""The tracking plan: clusters of many scans to track ids, events, displacements and the track graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.operators import aggregates, tracking, trackstats
from skytrace.params import Grid, TrackingParams
from skytrace.session import attach, cut, keep


@dataclass
class Tracks:
    """Stage tables of one tracking run.

    ``tracked`` is the cluster table with id, step, dt and displacement; ``events`` are (scan, step, kind, id, related).
    """

    pairs: DataFrame
    scored: DataFrame
    matches: DataFrame
    merges: DataFrame
    splits: DataFrame
    retagged: DataFrame
    fresh: DataFrame
    ids: DataFrame
    tracked: DataFrame
    events: DataFrame


def track(
    clusters: DataFrame,
    members: DataFrame,
    scans: DataFrame,
    grid: Grid,
    params: TrackingParams,
    limits: dict[str, tuple[float, float]] | None = None,
    highest_id: int = 0,
    known: DataFrame | None = None,
) -> Tracks:
    """Track every linked pair of scans. A scan whose predecessor is missing or too far in time starts new tracks.

    ``known(cluster, id)`` gives ids from an earlier run to the clusters of the first scan, for incremental runs.
    """
    pairs = keep(tracking.scan_pairs(scans, params))
    base = clusters
    if params.correlation_weight != 0.0 and params.tracking_variable:
        lo, hi = limits[params.tracking_variable]
        hist = aggregates.histogram_arrays(members, params.tracking_variable, lo, hi)
        base = cut(clusters.join(hist.select("cluster", "hist"), "cluster"))
    candidates = cut(tracking.candidate_pairs(base, members, pairs, grid, params))
    maxima = tracking.pair_maxima(candidates, base, pairs, grid, params)
    scored = keep(tracking.score(candidates, maxima, pairs, params))
    matches = tracking.match(scored)
    via = lambda df, how: df.select("pair", "n", "m", F.lit(how).alias("via"))
    merge_events, merge_tags = tracking.merges(scored, matches, params)
    links = keep(via(matches, "match").unionByName(via(merge_tags, "merge")))
    split_events, split_tags = tracking.splits(scored, links, params)
    links = keep(links.unionByName(via(split_tags, "split")))
    merge_events, split_events = keep(merge_events), keep(split_events)
    retagged = links.where("via <> 'match'").drop("via")
    if known is None:
        fresh = tracking.fresh_ids(clusters, matches, highest_id)
    else:
        rest = clusters.join(known.select("cluster"), "cluster", "left_anti")
        fresh = tracking.fresh_ids(rest, matches, highest_id).select("cluster", "new_id").unionByName(
            known.select("cluster", F.col("id").alias("new_id"))
        )
    fresh = keep(fresh)
    ids = keep(tracking.resolve_ids(clusters, links, fresh))
    tracked = keep(_tracked(clusters, ids, matches, pairs, grid))
    events = keep(_events(clusters, ids, pairs, matches, links, merge_events, split_events))
    return Tracks(pairs, scored, matches, merge_events, split_events, retagged, fresh, ids, tracked, events)


def _tracked(clusters: DataFrame, ids: DataFrame, matches: DataFrame, pairs: DataFrame, grid: Grid) -> DataFrame:
    """Cluster table with id, step, dt and the displacement of matched clusters."""
    centres = ["center_" + d for d in grid.dims]
    before = clusters.select(F.col("cluster").alias("m"), *[F.col(c).alias("_p_" + c) for c in centres])
    moved = matches.select(F.col("n").alias("cluster"), "m").join(before, "m").drop("m")
    table = clusters.join(ids, "cluster").join(moved, "cluster", "left")
    for d in grid.dims:
        table = table.withColumn("d_" + d, F.col("center_" + d) - F.col("_p_center_" + d))
    return attach(table.drop(*["_p_" + c for c in centres]), pairs.select("scan", "step", "dt"), ["scan"], "cluster", part_of=pairs)


def _events(clusters, ids, pairs, matches, links, merge_events, split_events) -> DataFrame:
    """tracked, new, dropped, merge and split events per scan, in track ids."""
    empty = F.array().cast("array<bigint>")
    of_n = ids.select(F.col("cluster").alias("n"), F.col("id").alias("n_id"))
    of_m = ids.select(F.col("cluster").alias("m"), F.col("id").alias("m_id"))
    simple = lambda df, kind, id_col: df.select(
        F.col("pair").alias("scan"), F.lit(kind).alias("kind"), F.col(id_col).alias("id"), empty.alias("related")
    )
    kept = links.select("pair", "n", "m")
    tracked = simple(kept.join(of_m, "m"), "tracked", "m_id")
    started = clusters.select(F.col("scan").alias("pair"), F.col("cluster").alias("n")).join(kept.select("n"), "n", "left_anti")
    new = simple(started.join(of_n, "n"), "new", "n_id")
    gone = simple(tracking.dropped(clusters, matches, pairs).join(of_m, "m"), "dropped", "m_id")

    def compound(events, hub, hub_ids, leaf, leaf_ids, kind):
        parts = events.select("pair", hub, F.explode("parts").alias(leaf)).join(leaf_ids, leaf)
        grouped = parts.groupBy("pair", hub).agg(F.array_sort(F.collect_set(leaf + "_id")).alias("related"))
        return grouped.join(hub_ids, hub).select(
            F.col("pair").alias("scan"), F.lit(kind).alias("kind"), F.col(hub + "_id").alias("id"), "related"
        )

    merged = compound(merge_events, "n", of_n, "m", of_m, "merge")
    divided = compound(split_events, "m", of_m, "n", of_n, "split")
    union = tracked.unionByName(new).unionByName(gone).unionByName(merged).unionByName(divided)
    return attach(union, pairs.select("scan", "step"), ["scan"], "id", part_of=pairs)


def graph(tracks: Tracks) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of the track graph."""
    nodes = trackstats.nodes(tracks.tracked)
    events = tracks.events
    of = lambda kind: events.where(F.col("kind") == kind).select("step", "id", "related")
    return nodes, trackstats.links(nodes, of("tracked").select("step", "id"), of("merge"), of("split"))
