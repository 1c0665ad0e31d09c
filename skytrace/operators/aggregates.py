"""Per-cluster aggregates, histograms and rank correlations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.operators.ordering import group_medians, number_rows
from skytrace.params import Grid
from skytrace.session import attach

DEFAULT_BINS = 25


def summarise(members: DataFrame, grid: Grid, names: list[str], modes: list[str] | None = None) -> DataFrame:
    """One pass over the members: size, centre, bounding box, mode and value ranges per cluster.

    ``modes`` names the columns the mode's value part is averaged from (smoothed values if those were kept).
    """
    aggs = [F.count("*").alias("size"), F.min("pid").alias("first_pid")]
    for d in grid.dims:
        c = "c_" + d
        aggs += [F.avg(c).alias("center_" + d), F.min(c).alias("bbox_min_" + d), F.max(c).alias("bbox_max_" + d)]
    for n, m in zip(names, modes or names):
        aggs += [F.avg(m).alias("mode_" + n), F.min(n).alias("min_" + n), F.max(n).alias("max_" + n)]
    by = ["scan", "cluster"] + (["ts"] if "ts" in members.columns else [])
    return members.groupBy(*by).agg(*aggs)


def _squared_distance(columns: list[str], centres: list[str], factors: tuple[float, ...]) -> Column:
    terms = []
    for c, m, f in zip(columns, centres, factors):
        d = (F.col(c) - F.col(m)) * F.lit(f)
        terms.append(d * d)
    return reduce(lambda a, b: a + b, terms)


def radius(members: DataFrame, clusters: DataFrame, grid: Grid) -> DataFrame:
    """Mean distance in metres of the members to the spatial part of the mode."""
    centres = clusters.select("cluster", *["center_" + d for d in grid.dims])
    joined = attach(members.select("scan", "cluster", "gid", *["c_" + d for d in grid.dims]), centres, ["cluster"], "gid", part_of=clusters)
    d2 = _squared_distance(["c_" + d for d in grid.dims], ["center_" + d for d in grid.dims], grid.meters)
    return joined.groupBy("scan", "cluster").agg(F.avg(F.sqrt(d2)).alias("radius_m"))


def weighed_center(members: DataFrame, grid: Grid, variable: str, inverted: bool = False) -> DataFrame:
    """Centre weighted by the variable's share of its range in the cluster; plain centre if it is constant.

    ``inverted`` gives the largest weight to the smallest value.
    """
    extremes = members.groupBy("cluster").agg(F.min(variable).alias("_lo"), F.max(variable).alias("_hi"))
    joined = attach(members.select("scan", "cluster", "gid", variable, *["c_" + d for d in grid.dims]), extremes, ["cluster"], "gid")
    mass = (F.col("_hi") - F.col(variable)) if inverted else (F.col(variable) - F.col("_lo"))
    share = F.coalesce(F.try_divide(mass, F.col("_hi") - F.col("_lo")), F.lit(1.0))
    weighted = joined.withColumn("_w", share)
    aggs = [(F.sum(F.col("c_" + d) * F.col("_w")) / F.sum("_w")).alias("center_" + d) for d in grid.dims]
    return weighted.groupBy("scan", "cluster").agg(*aggs)


def value_medians(members: DataFrame, names: list[str]) -> DataFrame:
    return group_medians(members, "cluster", names)


def histogram_bin(value: Column, lo: float, hi: float, bins: int = DEFAULT_BINS) -> Column:
    """Zero-based bin; values at or above the maximum go to the last bin, below the minimum to none."""
    if hi == lo:
        return F.lit(0)
    dx = (float(hi) - float(lo)) / bins
    inside = F.least(F.floor((value - F.lit(float(lo))) / F.lit(dx)), F.lit(bins - 1)).cast("int")
    return F.when(value >= F.lit(float(hi)), F.lit(bins - 1)).when(value >= F.lit(float(lo)), inside)


def histograms(members: DataFrame, variable: str, lo: float, hi: float, bins: int = DEFAULT_BINS) -> DataFrame:
    """(scan, cluster, bin, n) in long form."""
    binned = members.select("scan", "cluster", histogram_bin(F.col(variable), lo, hi, bins).alias("bin"))
    return binned.where("bin IS NOT NULL").groupBy("scan", "cluster", "bin").agg(F.count("*").alias("n"))


def histogram_arrays(members: DataFrame, variable: str, lo: float, hi: float, bins: int = DEFAULT_BINS) -> DataFrame:
    """(scan, cluster, hist ARRAY<BIGINT>): conditional counts, combined map-side."""
    n_bins = 1 if hi == lo else bins
    b = histogram_bin(F.col(variable), lo, hi, bins)
    counts = members.withColumn("_bin", b).groupBy("scan", "cluster").agg(
        *[F.count_if(F.col("_bin") == i).alias(f"_h{i}") for i in range(n_bins)]
    )
    return counts.select("scan", "cluster", F.array(*[f"_h{i}" for i in range(n_bins)]).alias("hist"))


def kendall(a: Column, b: Column) -> Column:
    """Kendall's tau-b of two count arrays of the same length; -1 if undefined."""
    n = F.size(a)
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda i: F.transform(
                F.sequence(i + 1, n),
                lambda j: F.struct(
                    F.signum(F.element_at(a, i) - F.element_at(a, j)).alias("u"),
                    F.signum(F.element_at(b, i) - F.element_at(b, j)).alias("v"),
                ),
            ),
        )
    )
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + f(p))
    concordance = total(lambda p: p["u"] * p["v"])
    n1, n2 = total(lambda p: F.abs(p["u"])), total(lambda p: F.abs(p["v"]))
    return F.coalesce(F.try_divide(concordance, F.sqrt(n1) * F.sqrt(n2)), F.lit(-1.0))


def _average_ranks(a: Column) -> Column:
    rank = lambda x: (
        F.size(F.filter(a, lambda y: y < x)) + (F.size(F.filter(a, lambda y: y == x)) + 1) / F.lit(2.0)
    )
    return F.transform(a, rank)


def spearman(a: Column, b: Column) -> Column:
    """Spearman's rho of two count arrays with average ranks for ties; -1 if undefined."""
    ra, rb = _average_ranks(a), _average_ranks(b)
    mean = (F.size(a) + 1) / F.lit(2.0)
    dot = lambda p, q: F.aggregate(
        F.zip_with(p, q, lambda x, y: (x - mean) * (y - mean)), F.lit(0.0), lambda acc, x: acc + x
    )
    return F.coalesce(F.try_divide(dot(ra, rb), F.sqrt(dot(ra, ra)) * F.sqrt(dot(rb, rb))), F.lit(-1.0))


def weight_statistics(members: DataFrame) -> DataFrame:
    """Dynamic range, sum and mean of the weight response per cluster."""
    return members.groupBy("scan", "cluster").agg(
        F.min("w").alias("w_min"), F.max("w").alias("w_max"), F.sum("w").alias("w_sum"), F.avg("w").alias("w_mean")
    )


def modal_weight(clusters: DataFrame, weighted: DataFrame, grid: Grid) -> DataFrame:
    """Weight at the grid cell of each cluster's mode; 0 where no weight was computed."""
    cell = {
        d: F.round((F.col("center_" + d) - F.lit(o)) / F.lit(r)).cast("int")
        for d, o, r in zip(grid.dims, grid.origin, grid.resolution)
    }
    at = clusters.select("scan", "cluster", *[c.alias(d) for d, c in cell.items()])
    joined = at.join(weighted.select("scan", *grid.dims, "w"), ["scan", *grid.dims], "left")
    return joined.select("scan", "cluster", F.coalesce("w", F.lit(0.0)).alias("modal_weight"))


def count_value(df: DataFrame, column: str, value: float, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(F.col(column) == F.lit(value)).alias("n"))


def rank_within(df: DataFrame, group: str, value: str, tie: str, out: str) -> DataFrame:
    """Position by falling value within each group, ties by ``tie``.

    All rows are numbered by group, value and tie in range partitions; a group's positions start at its first number. Neither a hot group nor equal values
    meet in one task.
    """
    numbered = number_rows(df, [F.col(group), F.desc(value), F.col(tie)], "_number")
    first = numbered.groupBy(group).agg(F.min("_number").alias("_first"))
    ranked = attach(numbered, first, [group], tie)
    return ranked.select(group, tie, (F.col("_number") - F.col("_first") + 1).cast("bigint").alias(out))
