"""Tracking: which cluster of a scan continues which cluster of the scan before.

All scan pairs are matched at once. Identity is then a label: every track starts with a fresh number and each
continuation points to its predecessor, so ids follow by pointer jumping along the chains. A pair is named by
its current scan (``pair`` = scan); ``n`` is a current cluster, ``m`` a previous one, both by their label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytrace.functions.special import relative_erfc
from skytrace.operators.aggregates import kendall
from skytrace.operators.clustering import cell_cover
from skytrace.operators.neighbours import near_pairs
from skytrace.operators.ordering import number_rows
from skytrace.params import Grid, TrackingParams
from skytrace.session import attach, cut
from skytrace.session import keep as store

# Scores are compared after rounding to this many digits.
DIGITS = 9


def scan_pairs(scans: DataFrame, params: TrackingParams) -> DataFrame:
    """Each scan with its predecessor in time and the gate: 0 < dt <= max. ``scans(scan, ts)``, unique ts order."""
    indexed = cut(number_rows(scans, "ts", "step"))
    before = indexed.select((F.col("step") + 1).alias("step"), F.col("scan").alias("prev_scan"), F.col("ts").alias("prev_ts"))
    dt = (F.col("ts") - F.col("prev_ts")).cast("double")
    return indexed.join(before, "step", "left").select(
        "scan", "ts", (F.col("step") - 1).alias("step"), "prev_scan", dt.alias("dt"),
        F.coalesce((dt > 0) & (dt <= params.max_delta_t), F.lit(False)).alias("linked"),
    )


def advect(members: DataFrame, clusters: DataFrame, grid: Grid) -> DataFrame:
    """Move members by their cluster's displacement (``d_<dim>``, NULL = none) to new coordinates and cells."""
    shift = clusters.select("cluster", *["d_" + d for d in grid.dims])
    moved = attach(members, shift, ["cluster"], "gid", "left")
    pid = F.lit(0).cast("bigint")
    for d, o, r, s in zip(grid.dims, grid.origin, grid.resolution, grid.strides):
        moved = moved.withColumn("c_" + d, F.col("c_" + d) + F.coalesce("d_" + d, F.lit(0.0)))
        moved = moved.withColumn(d, F.round((F.col("c_" + d) - F.lit(o)) / F.lit(r)).cast("int"))
        pid = pid + F.col(d) * F.lit(s)
    inside = F.lit(True)
    for d, n in zip(grid.dims, grid.sizes):
        inside = inside & F.col(d).between(0, n - 1)
    return moved.withColumn("pid", F.when(inside, pid).cast("bigint")).drop(*["d_" + d for d in grid.dims])


def covers(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cells shared by clusters of linked scans: (pair, n, m, shared)."""
    linked = pairs.where("linked").select("scan", "prev_scan")
    as_current = attach(members.select("scan", "pid", "cluster"), linked.select("scan"), ["scan"], "pid", part_of=pairs)
    as_previous = attach(
        members.select(F.col("scan").alias("prev_scan"), "pid", "cluster"), linked, ["prev_scan"], "pid", part_of=pairs
    )
    return cell_cover(
        as_current.select(F.col("scan").alias("pair"), "pid", F.col("cluster").alias("n")),
        as_previous.select(F.col("scan").alias("pair"), "pid", F.col("cluster").alias("m")),
    )


def _sides(clusters: DataFrame, pairs: DataFrame, grid: Grid, extra: list[str]) -> tuple[DataFrame, DataFrame]:
    """Current and previous clusters of linked pairs with centres in metres."""
    metres = [(F.col("center_" + d) * F.lit(f)).alias("m_" + d) for d, f in zip(grid.dims, grid.meters)]
    slim = clusters.select("scan", "cluster", "size", "radius_m", *metres, *extra)
    linked = pairs.where("linked").select("scan", "prev_scan", "dt")
    current = attach(slim, linked.select("scan", "dt"), ["scan"], "cluster", part_of=pairs).withColumnRenamed("scan", "pair")
    previous = attach(slim.withColumnRenamed("scan", "prev_scan"), linked, ["prev_scan"], "cluster", part_of=pairs)
    previous = previous.withColumnRenamed("scan", "pair").drop("prev_scan")
    return current.withColumnRenamed("cluster", "n"), previous.withColumnRenamed("cluster", "m")


def _reachable(current: DataFrame, previous: DataFrame, grid: Grid, params: TrackingParams) -> DataFrame:
    """Pairs of clusters whose centres could be linked at the maximum speed.

    Centres are put in units of the pair's own maximum displacement, so one range join with reach 1 serves
    all pairs whatever their time difference.
    """
    unit = lambda df: df.withColumns({"u_" + d: F.col("m_" + d) / (F.col("dt") * params.max_velocity) for d in grid.dims})
    a = unit(current).select("pair", "n", *["u_" + d for d in grid.dims])
    b = unit(previous).select("pair", "m", *["u_" + d for d in grid.dims])
    # a hair above 1: the exact limit is tested in metres afterwards
    reach = {"u_" + d: 1.0 + 1e-9 for d in grid.dims}
    return near_pairs(a, b, reach, ("pair",), min_block=0.0).select("pair", "n", F.col("n_m").alias("m"))


def candidate_pairs(
    clusters: DataFrame, members: DataFrame, pairs: DataFrame, grid: Grid, params: TrackingParams
) -> DataFrame:
    """Every pair of clusters that is reachable or overlaps, with its measures and the ``possible`` flag.

    Pairs that are neither can not match (velocity limit) nor merge or split (no shared cell), so leaving
    them out changes nothing. ``clusters`` needs ``hist`` if the histogram weight is used.
    """
    use_hist = params.correlation_weight != 0.0 and "hist" in clusters.columns
    extra = ["hist"] if use_hist else []
    current, previous = _sides(clusters, pairs, grid, extra)
    shared = covers(members, pairs)
    near = _reachable(current, previous, grid, params).withColumn("shared", F.lit(0).cast("bigint"))
    both = near.unionByName(shared).groupBy("pair", "n", "m").agg(F.sum("shared").alias("shared"))
    cols = ["size", "radius_m", *["m_" + d for d in grid.dims], *extra]
    p_side = previous.select("m", *[F.col(c).alias("p_" + c) for c in cols])
    joined = both.join(current.drop("pair"), "n").join(p_side, "m")
    d2 = F.lit(0.0)
    for d in grid.dims:
        delta = F.col("m_" + d) - F.col("p_m_" + d)
        d2 = d2 + delta * delta
    larger, smaller = F.greatest("size", "p_size"), F.least("size", "p_size")
    out = joined.select(
        "pair", "n", "m", "dt", "size", "p_size", "shared",
        (F.col("shared") / F.col("p_size")).alias("cover_old_by_new"),
        (F.col("shared") / F.col("size")).alias("cover_new_by_old"),
        F.sqrt(d2).alias("dr_m"),
        (larger - smaller).cast("double").alias("size_diff"),
        ((larger - smaller) / smaller).alias("size_deviation"),
        (F.col("p_radius_m") >= 0.5 * params.max_velocity * F.col("dt")).alias("needs_overlap"),
        *([kendall(F.col("hist"), F.col("p_hist")).alias("tau")] if use_hist else [F.lit(0.0).alias("tau")]),
    )
    return out.withColumn("possible", overlap_ok(params) & size_ok(params) & velocity_ok(params))


def overlap_ok(params: TrackingParams) -> Column:
    """A previous cluster too large to move off its own area must be overlapped."""
    if not params.use_overlap_constraint:
        return F.lit(True)
    return ~F.col("needs_overlap") | (F.col("shared") > 0)


def size_ok(params: TrackingParams) -> Column:
    return F.col("size_deviation") <= F.lit(float(params.max_size_deviation))


def velocity_ok(params: TrackingParams) -> Column:
    return F.col("dr_m") <= F.lit(float(params.max_velocity)) * F.col("dt")


def pair_maxima(candidates: DataFrame, clusters: DataFrame, pairs: DataFrame, grid: Grid, params: TrackingParams) -> DataFrame:
    """Largest displacement of the possible pairs and largest size difference of the pairs that meet the overlap
    constraint, per scan pair.

    The second maximum ranges over all pairs of clusters, near or far. It needs no pair list: without an overlap
    requirement the extreme sizes give it; for previous clusters that need overlap only overlapping pairs count.
    """
    far = candidates.groupBy("pair").agg(
        F.max(F.when(F.col("possible"), F.col("dr_m"))).alias("max_dr"),
        F.max(F.when(F.col("shared") > 0, F.col("size_diff"))).alias("_overlapping"),
    )
    current, previous = _sides(clusters, pairs, grid, [])
    c = current.groupBy("pair").agg(F.max("size").alias("_c_hi"), F.min("size").alias("_c_lo"))
    free = F.lit(True)
    if params.use_overlap_constraint:
        free = F.col("radius_m") < 0.5 * params.max_velocity * F.col("dt")
    p = previous.where(free).groupBy("pair").agg(F.max("size").alias("_p_hi"), F.min("size").alias("_p_lo"))
    out = far.join(c, "pair", "left").join(p, "pair", "left")
    largest = F.greatest(
        F.col("_overlapping"), (F.col("_c_hi") - F.col("_p_lo")).cast("double"), (F.col("_p_hi") - F.col("_c_lo")).cast("double")
    )
    max_dh = F.when(F.coalesce(largest, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(largest)
    return out.select("pair", "max_dr", max_dh.alias("max_dh"))


def score(candidates: DataFrame, maxima: DataFrame, pairs: DataFrame, params: TrackingParams) -> DataFrame:
    """Add ``likelihood`` and the merge and split criteria. ``maxima`` has at most one row per scan pair."""
    df = attach(candidates, maxima, ["pair"], "n", part_of=pairs)
    near = relative_erfc(F.col("dr_m"), F.col("max_dr"))
    alike = relative_erfc(F.col("size_diff"), F.col("max_dh")) if params.size_weight != 0 else F.lit(1.0)
    likelihood = F.lit(float(params.range_weight)) * near
    if params.tracking_variable is not None:
        likelihood = (
            likelihood
            + F.lit(float(params.size_weight)) * alike
            + F.lit(float(params.correlation_weight)) * F.col("tau")
        )
    return df.withColumns({
        "likelihood": F.round(likelihood, DIGITS),
        "merge_score": F.round(F.col("cover_new_by_old") * (near + alike), DIGITS),
        "split_score": F.round(F.col("cover_old_by_new") * (near + alike), DIGITS),
    })


def match(scored: DataFrame) -> DataFrame:
    """Greedy one-to-one assignment by falling likelihood (ties: smaller n, then m), computed in rounds.

    A pair that is best for both its clusters among the pairs left is one the sequential pass would take, so each
    round accepts all such pairs and drops the other pairs of their clusters. An accepted pair is alone in its windows
    afterwards and stays accepted, so rounds repeat until only accepted pairs are left.
    """
    state = scored.where("possible").select("pair", "n", "m", "likelihood", "dr_m", "dt")
    while True:
        state = store(_match_round(_match_round(state.drop("hit"))))
        if state.where("NOT hit").isEmpty():
            return state.drop("hit")


def _match_round(df: DataFrame) -> DataFrame:
    """Windows over the few candidates of one cluster; a round keeps accepted pairs and pairs still open."""
    of_n, of_m = Window.partitionBy("n"), Window.partitionBy("m")
    return (
        df.drop("hit").withColumn("_rn", F.row_number().over(of_n.orderBy(F.desc("likelihood"), "m")))
        .withColumn("_rm", F.row_number().over(of_m.orderBy(F.desc("likelihood"), "n")))
        .withColumn("hit", (F.col("_rn") == 1) & (F.col("_rm") == 1))
        .withColumn("_m_taken", F.bool_or("hit").over(of_m))
        .withColumn("_n_taken", F.bool_or("hit").over(of_n))
        .where("hit OR NOT (_m_taken OR _n_taken)")
        .drop("_rn", "_rm", "_m_taken", "_n_taken")
    )


def fresh_ids(clusters: DataFrame, matches: DataFrame, highest: int = 0) -> DataFrame:
    """Unmatched clusters get the next numbers in scan and cluster order: (cluster, new_id)."""
    unmatched = cut(clusters.select("scan", "cluster").join(matches.select(F.col("n").alias("cluster")), "cluster", "left_anti"))
    return number_rows(unmatched, "cluster", "new_id").withColumn("new_id", F.col("new_id") + F.lit(highest))


def dropped(clusters: DataFrame, matches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Previous clusters of linked pairs that found no successor in matchmaking: (pair, m)."""
    linked = pairs.where("linked").select(F.col("prev_scan").alias("scan"), F.col("scan").alias("pair"))
    before = attach(clusters.select("scan", "cluster"), linked, ["scan"], "cluster", part_of=pairs)
    return before.select("pair", F.col("cluster").alias("m")).join(matches.select("m"), "m", "left_anti")


def merge_candidates(scored: DataFrame, matches: DataFrame, params: TrackingParams) -> DataFrame:
    """Per current cluster: its own predecessor, and untracked predecessors covered enough by it for which no other
    current cluster scores higher. (pair, n, m, own, cover, score)."""
    own = matches.select("pair", "n", "m").withColumn("own", F.lit(True))
    loose = scored.where("shared > 0").join(matches.select("m"), "m", "left_anti")
    return _candidates(loose, own, scored, "m", "merge_score", "cover_old_by_new", "cover_new_by_old", params)


def split_candidates(scored: DataFrame, links: DataFrame, params: TrackingParams) -> DataFrame:
    """Per previous cluster: its own successor (matched or re-tagged by a merge), and untracked successors covered enough by
    it for which no other previous cluster scores higher."""
    own = links.select("pair", "n", "m").withColumn("own", F.lit(True))
    loose = scored.where("shared > 0").join(links.select("n"), "n", "left_anti")
    return _candidates(loose, own, scored, "n", "split_score", "cover_new_by_old", "cover_old_by_new", params)


def _candidates(loose, own, scored, side, score_col, share, continuation, params) -> DataFrame:
    best = loose.groupBy(side).agg(F.max(score_col).alias("_best"))
    chosen = (
        loose.join(best, side)
        .where((F.col(share) >= F.lit(params.merge_split_threshold)) & (F.col(score_col) >= F.col("_best")))
        .select("pair", "n", "m", F.lit(False).alias("own"), F.col(continuation).alias("cover"), F.col(score_col).alias("score"))
    )
    kept = own.join(scored.select("n", "m", F.col(continuation).alias("cover"), F.col(score_col).alias("score")), ["n", "m"])
    return chosen.unionByName(kept.select(*chosen.columns))


def _events(candidates: DataFrame, hub: str, leaf: str, params: TrackingParams) -> tuple[DataFrame, DataFrame]:
    """Hubs with two or more candidates, and the re-tags (n, m) of hubs without an own partner."""
    events = candidates.groupBy("pair", hub).agg(
        F.count("*").alias("candidates"), F.bool_or("own").alias("has_own"), F.array_sort(F.collect_set(leaf)).alias("parts")
    ).where("candidates > 1")
    strong = candidates.where(F.col("cover") >= F.lit(params.continuation_threshold))
    if not params.continue_ids:
        return events, strong.limit(0).select("pair", hub, leaf)
    top = strong.groupBy(hub).agg(F.max("score").alias("_top"))
    # a tie for the best score continues no one, and a partner is continued at most once
    winners = (
        strong.join(events.where("NOT has_own").select(hub), hub)
        .join(top, hub)
        .where("score = _top")
        .groupBy("pair", hub).agg(F.count("*").alias("_ties"), F.min(leaf).alias(leaf))
        .where("_ties = 1")
    )
    return events, winners.groupBy("pair", leaf).agg(F.min(hub).alias(hub)).select("pair", hub, leaf)


def merges(scored: DataFrame, matches: DataFrame, params: TrackingParams) -> tuple[DataFrame, DataFrame]:
    """(events: pair, n, parts = previous clusters), (re-tags: pair, n, m)."""
    return _events(store(merge_candidates(scored, matches, params)), "n", "m", params)


def splits(scored: DataFrame, links: DataFrame, params: TrackingParams) -> tuple[DataFrame, DataFrame]:
    """(events: pair, m, parts = current clusters), (re-tags: pair, m, n)."""
    return _events(store(split_candidates(scored, links, params)), "m", "n", params)


def _double(state: DataFrame) -> DataFrame:
    """Replace every unfinished ancestor by that ancestor's own."""
    table = state.select(F.col("cluster").alias("_at"), F.col("anc").alias("_anc"), F.col("fin").alias("_fin"))
    moved = state.where("NOT fin").join(table, F.col("anc") == F.col("_at"))
    return state.where("fin").unionByName(moved.select("cluster", F.col("_anc").alias("anc"), F.col("_fin").alias("fin")))


def resolve_ids(clusters: DataFrame, links: DataFrame, fresh: DataFrame) -> DataFrame:
    """Track id of every cluster: the fresh number of the first cluster of its chain.

    ``links(n, m)``: n continues m, one to one. Each round doubles the distance to the ancestor. Only chains
    that have not reached their start take part; their ancestors are all different, so no join key is hot.
    """
    up = links.select(F.col("n").alias("cluster"), F.col("m").alias("anc"))
    started = links.select(F.col("n").alias("anc"), F.lit(False).alias("fin"))
    roots = clusters.select("cluster").join(up.select("cluster"), "cluster", "left_anti")
    state = roots.select("cluster", F.col("cluster").alias("anc"), F.lit(True).alias("fin")).unionByName(
        up.join(started, "anc", "left").select("cluster", "anc", F.coalesce("fin", F.lit(True)).alias("fin"))
    )
    state = store(_double(state))
    while not state.where("NOT fin").isEmpty():
        state = store(_double(_double(state)))
    # all clusters of a long track share one root: a size-checked lookup
    numbers = fresh.select(F.col("cluster").alias("anc"), F.col("new_id").alias("id"))
    return attach(state.drop("fin"), numbers, ["anc"], "cluster", part_of=fresh).select("cluster", "id")
