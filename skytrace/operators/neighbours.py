"""Neighbourhood joins: every range search is an equi-join on spatial blocks plus a residual predicate.

A left row lives in exactly one block. A right row is copied to the blocks its reach touches: about twice per
dimension with blocks of twice the reach, 1.3 times with blocks of six times the reach. One block key never holds more rows
than the block has cells. A scan holding a third of all rows is therefore spread over all its blocks.
Aggregations grouped by ``keys(...)`` + left columns reuse the join's partitioning: no second shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytrace.session import cut, keep

# A block has about this many cells: larger ones copy fewer rows over their rims, but more pairs are tested.
BLOCK_CELLS = 144


def block_column(d: str) -> str:
    return f"_b_{d}"


def keys(dims: tuple[str, ...], on: tuple[str, ...] = ("scan",)) -> list[str]:
    return [*on, *(block_column(d) for d in dims)]


def block_sides(reach: dict[str, float], min_block: float | None = None) -> dict[str, float]:
    """Length of a block per dimension: at least twice the reach, and ``min_block`` (default: as ``BLOCK_CELLS`` asks for)."""
    least = int(BLOCK_CELLS ** (1.0 / len(reach)) + 1e-9) if min_block is None else min_block
    return {d: max(least, 2 * n) for d, n in reach.items()}


def home_blocks(left: DataFrame, reach: dict[str, float], min_block: float | None = None) -> DataFrame:
    """Rows with the block they live in, for a left side that is dealt out once and joined often."""
    for d, side in block_sides(reach, min_block).items():
        left = left.withColumn(block_column(d), F.floor(F.col(d) / F.lit(side)).cast("bigint"))
    return left


def near_pairs(
    left: DataFrame,
    right: DataFrame,
    reach: dict[str, float],
    on: tuple[str, ...] = ("scan",),
    prefix: str = "n_",
    min_block: float | None = None,
    blocked: bool = False,
) -> DataFrame:
    """Pairs whose distance along every dimension of ``reach`` is at most that reach.

    Right columns come out prefixed; the ``on`` columns and block columns come once. ``blocked`` says that the left side comes from
    :func:`home_blocks` with the same reach.
    """
    dims = tuple(reach)
    side = block_sides(reach, min_block)
    home = left if blocked else home_blocks(left, reach, min_block)
    halo = right.select(*on, *[F.col(c).alias(prefix + c) for c in right.columns if c not in on])
    for d in dims:
        n = F.col(prefix + d)
        first = F.floor((n - F.lit(reach[d])) / F.lit(side[d])).cast("bigint")
        last = F.floor((n + F.lit(reach[d])) / F.lit(side[d])).cast("bigint")
        halo = halo.withColumn(block_column(d), F.explode(F.sequence(first, last)))
    pairs = home.join(halo, keys(dims, on))
    for d in dims:
        pairs = pairs.where(F.abs(F.col(d) - F.col(prefix + d)) <= F.lit(reach[d]))
    return pairs


def ellipsoid_distance2(columns: list[str], bandwidth: list[float], prefix: str = "n_") -> Column:
    """Squared distance with every component divided by its bandwidth, summed in column order."""
    square = lambda t: t * t
    terms = [square((F.col(c) - F.col(prefix + c)) / F.lit(float(h))) for c, h in zip(columns, bandwidth)]
    return reduce(lambda a, b: a + b, terms)


def ellipsoid_pairs(
    left: DataFrame,
    right: DataFrame,
    reach: dict[str, float],
    columns: list[str],
    bandwidth: list[float],
    on: tuple[str, ...] = ("scan",),
    prefix: str = "n_",
    min_block: float | None = None,
    blocked: bool = False,
) -> DataFrame:
    """Range search: neighbours y of x with sum(((x_i - y_i) / h_i)^2) <= 1. Adds ``d2``."""
    pairs = near_pairs(left, right, reach, on, prefix, min_block, blocked)
    return pairs.withColumn("d2", ellipsoid_distance2(columns, bandwidth, prefix)).where("d2 <= 1.0")


def box_pairs(
    left: DataFrame,
    right: DataFrame,
    reach: dict[str, float],
    value_ranges: dict[str, float],
    on: tuple[str, ...] = ("scan",),
) -> DataFrame:
    """Box search: index box plus one absolute limit per variable."""
    pairs = near_pairs(left, right, reach, on)
    for v, h in value_ranges.items():
        pairs = pairs.where(F.abs(F.col(v) - F.col("n_" + v)) <= F.lit(float(h)))
    return pairs


def moore_pairs(left: DataFrame, right: DataFrame, dims: tuple[str, ...], reach: int = 1) -> DataFrame:
    """All cells within ``reach`` in every index, the cell itself included."""
    return near_pairs(left, right, {d: reach for d in dims})


def nearest(
    left: DataFrame,
    right: DataFrame,
    k: int,
    columns: list[str],
    bandwidth: list[float],
    left_key: str,
    right_key: str,
    on: tuple[str, ...],
    start: float = 1.0,
    blocks: int | None = None,
) -> DataFrame:
    """Exact k nearest neighbours by growing radius, in bandwidth-scaled space.

    Candidates are found in blocks of the first ``blocks`` columns (all by default); the distance is measured over every column.

    Rows that have k neighbours inside the searched radius are final; the others try twice the radius. The
    loop ends when nobody is left or the radius spans the data; the last round then returns what exists.
    """
    scaled = lambda df: df.select(*[c for c in df.columns if c not in columns], *[
        (F.col(c) / F.lit(float(h))).alias(c) for c, h in zip(columns, bandwidth)])
    # every round searches the right rows
    left, right = scaled(left), keep(scaled(right))
    pending = cut(left)
    span = max(
        float(v) for v in right.agg(*[F.coalesce(F.max(c) - F.min(c), F.lit(0.0)).alias(c) for c in columns]).first()
    )
    radius, done = start, []
    ones = [1.0] * len(columns)
    while True:
        last = radius >= span * len(columns) ** 0.5 + 1e-9
        reach = {c: radius for c in columns[:blocks]}
        pairs = near_pairs(pending, right, reach, on, min_block=4 * radius if len(reach) <= 2 else 0.0)
        found = pairs.withColumn("d2", ellipsoid_distance2(columns, ones))
        if not last:
            found = found.where(F.col("d2") <= radius * radius)
        order = Window.partitionBy(*on, left_key).orderBy("d2", "n_" + right_key)
        best = cut(
            found.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k)
            .select(*on, left_key, "rank", "n_" + right_key, F.sqrt("d2").alias("distance"))
        )
        if last:
            done.append(best)
            break
        full = best.where(F.col("rank") == k).select(left_key)
        done.append(best.join(full, left_key, "left_semi"))
        pending = cut(pending.join(full, left_key, "left_anti"))
        if pending.isEmpty():
            break
        radius *= 2.0
    return reduce(DataFrame.unionByName, done)
