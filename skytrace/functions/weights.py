"""Per-point weight functions. ``weigh`` adds a column ``w``; user functions are callables on the points."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.functions.kernels import gauss
from skytrace.functions.satellite import brightness_temperature
from skytrace.operators.neighbours import ellipsoid_pairs, keys
from skytrace.params import Grid

# lower and upper limit per variable: numbers, or columns where they differ from scan to scan
Limits = dict[str, tuple[float | Column, float | Column]]
WeightFunction = Callable[[DataFrame], DataFrame]


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _share(value: Column, lo: float | Column, hi: float | Column) -> Column:
    """Value over the width of the limits; 0 where a scan's limits coincide."""
    if isinstance(lo, Column) or isinstance(hi, Column):
        return F.coalesce(F.try_divide(value, hi - lo), F.lit(0.0))
    return value / F.lit(float(hi) - float(lo))


def relative(name: str, limits: Limits) -> Column:
    """Value scaled to [0, 1] between its limits."""
    lo, hi = limits[name]
    return _share(F.col(name) - (lo if isinstance(lo, Column) else F.lit(float(lo))), lo, hi)


def default_weight(names: list[str], limits: Limits) -> Column:
    """Mean over the variables of the value scaled to its range."""
    return _sum([relative(n, limits) for n in names]) / F.lit(float(len(names)))


def inverse_weight(names: list[str], limits: Limits) -> Column:
    """Sum over the variables of 1 - value / range; points created by smoothing weigh 0."""
    terms = [F.lit(1.0) - _share(F.col(n), *limits[n]) for n in names]
    return F.when(F.col("is_original"), _sum(terms)).otherwise(F.lit(0.0))


def pow10_weight(names: list[str]) -> Column:
    return _sum([F.pow(F.col(n), F.lit(10.0)) for n in names])


def gaussian_weight(columns: list[str], variance: float = 0.5, maximum: float = 3.0) -> Column:
    """Gaussian of the vector's length."""
    squares = _sum([F.col(c) * F.col(c) for c in columns])
    return F.exp(squares / F.lit(-2.0 * variance)) * F.lit(maximum)


def last_variable(names: list[str]) -> Column:
    return F.col(names[-1])


def distance_weight(columns: list[str], centre: list[float]) -> Column:
    """Distance to a fixed centre."""
    return F.sqrt(_sum([(F.col(c) - F.lit(float(m))) * (F.col(c) - F.lit(float(m))) for c, m in zip(columns, centre)]))


def brightband_weight() -> Column:
    return F.lit(0.0)


# Contribution of each variable of a combined radar/satellite composite.
COMPOSITE_FACTORS = {
    "cband_radolan_rx": 10.0,
    "msevi_l2_cmsaf_cot": 1.0,
    "msevi_l15_ir_108": 1.0,
    "linet_oase_tl": 10.0,
}
CLOUD_TYPE = "msevi_l2_nwcsaf_ct"


def cloud_type_weight(code: Column) -> Column:
    """Points by cloud height class, doubled for cumuliform clouds of some classes."""
    height = (
        F.when(code.between(7, 8), 1.0).when(code.between(9, 10), 1.5)
        .when(code.between(11, 12), 2.0).when(code.between(13, 14), 2.5).otherwise(0.0)
    )
    return height * F.when(code.isin(7, 11, 13), 2.0).otherwise(1.0)


def composite_score(names: list[str], limits: Limits) -> Column:
    terms = [F.lit(0.0)]
    for n in names:
        if n in COMPOSITE_FACTORS:
            terms.append(relative(n, limits) * F.lit(COMPOSITE_FACTORS[n]))
        elif n == CLOUD_TYPE:
            terms.append(cloud_type_weight(F.col(n)))
    return _sum(terms)


def composite_weight(points: DataFrame, grid: Grid, names: list[str], limits: Limits, spatial: tuple[float, ...]) -> DataFrame:
    """Sum over the spatial neighbours of their composite score, damped by distance."""
    cols = ["c_" + d for d in grid.dims]
    scored = points.select("scan", *grid.dims, *cols, composite_score(names, limits).alias("_u"))
    pairs = ellipsoid_pairs(points, scored, grid.reach(spatial), cols, list(spatial))
    distance = F.sqrt(_sum([(F.col(c) - F.col("n_" + c)) * (F.col(c) - F.col("n_" + c)) for c in cols]))
    own = [c for c in points.columns if c not in keys(grid.dims)]
    out = pairs.groupBy(*keys(grid.dims), *own).agg(F.sum(gauss(distance) * F.col("n__u")).alias("w"))
    return out.select(*points.columns, "w")


IR_108, WV_062, IR_134 = "msevi_l15_ir_108", "msevi_l15_wv_062", "msevi_l15_ir_134"
RADAR, LIGHTNING = "cband_radolan_rx", "linet_oase_tl"

# Score limits in degrees Celsius, as (original limits, modified limits).
WINDOW_WV = ((-35.0, -10.0), (None, 2.0))
WINDOW_CO2 = ((-25.0, -5.0), (-2.0, None))
TREND_LIMITS = ((-4.0, 3.0, 3.0), (-2.0, 1.0, 1.0))
RADAR_WINDOW = (25.0, 65.0)


def _within(value: Column, window: tuple[float | None, float | None]) -> Column:
    lo, hi = window
    tests = ([value >= lo] if lo is not None else []) + ([value <= hi] if hi is not None else [])
    return reduce(lambda a, b: a & b, tests)


def static_score(radiance: Callable[[str], Column], original_limits: bool) -> Column:
    """Number of the three static brightness-temperature tests a cell passes."""
    t108, t62, t134 = (brightness_temperature(radiance(c), c) for c in (IR_108, WV_062, IR_134))
    pick = 0 if original_limits else 1
    tests = [t108 <= 0.0, _within(t62 - t108, WINDOW_WV[pick]), _within(t134 - t108, WINDOW_CO2[pick])]
    return _sum([F.when(t, 1).otherwise(0) for t in tests])


def trend_score(now: Callable[[str], Column], before: Callable[[str], Column], original_limits: bool) -> Column:
    """Number of the three cooling tests passed since the comparison scan (15 minutes before)."""
    temperature = lambda radiance, c: brightness_temperature(radiance(c), c)
    d108 = temperature(now, IR_108) - temperature(before, IR_108)
    change = lambda c: (temperature(now, c) - temperature(now, IR_108)) - (temperature(before, c) - temperature(before, IR_108))
    cooling, wv, co2 = TREND_LIMITS[0 if original_limits else 1]
    last = (change(IR_134) > co2) if original_limits else (change(IR_134) >= co2)
    return _sum([F.when(t, 1).otherwise(0) for t in (d108 <= cooling, change(WV_062) >= wv, last)])


def initiation_weight(
    points: DataFrame,
    grid: Grid,
    cells: DataFrame,
    spatial: tuple[float, ...],
    comparison: DataFrame | None = None,
    satellite_only: bool = False,
    original_limits: bool = False,
) -> DataFrame:
    """Convective-initiation score per point.

    ``cells`` and ``comparison`` hold unpacked channels per (scan, cell), NULL where invalid. Lightning in range adds
    one; light rain in range raises the score to the maximum (8 with trend tests, 6 without, two less for satellite only).
    """
    maximum = (8 if comparison is not None else 6) - (2 if satellite_only else 0)
    on = ["scan", *grid.dims]
    channels = [IR_108, WV_062, IR_134]
    base = points.join(cells.select(*on, *[F.col(c).alias("_" + c) for c in channels]), on, "left")
    score = F.coalesce(static_score(lambda c: F.col("_" + c), original_limits), F.lit(0))
    if comparison is not None:
        before = comparison.select(*on, *[F.col(c).alias("_p_" + c) for c in channels])
        base = base.join(before, on, "left")
        score = score + F.coalesce(
            trend_score(lambda c: F.col("_" + c), lambda c: F.col("_p_" + c), original_limits), F.lit(0)
        )
    base = base.withColumn("_score", score.cast("double"))
    if satellite_only:
        return base.select(*points.columns, F.col("_score").alias("w"))
    cols = ["c_" + d for d in grid.dims]
    radar = F.coalesce(F.col(RADAR).between(*RADAR_WINDOW), F.lit(False))
    lightning = F.coalesce(F.col(LIGHTNING) > 0.0, F.lit(False))
    # only signals take part in the range join
    signals = (
        points.select("scan", *grid.dims, *cols)
        .join(cells.select(*on, radar.alias("_radar"), lightning.alias("_lightning")), on)
        .where("_radar OR _lightning")
    )
    pairs = ellipsoid_pairs(points.select("scan", *grid.dims, *cols), signals, grid.reach(spatial), cols, list(spatial))
    seen = pairs.groupBy(*keys(grid.dims), *grid.dims).agg(
        F.bool_or("n__radar").alias("_has_radar"), F.bool_or("n__lightning").alias("_has_lightning")
    )
    out = base.join(seen.select(*on, "_has_radar", "_has_lightning"), on, "left")
    w = (
        F.when(F.col("_has_radar"), F.lit(float(maximum)))
        .when(F.col("_has_lightning"), F.col("_score") + 1.0)
        .otherwise(F.col("_score"))
    )
    return out.select(*points.columns, w.alias("w"))


def weigh(points: DataFrame, name: str, grid: Grid, names: list[str], limits: Limits, spatial: tuple[float, ...]) -> DataFrame:
    """Weight by factory name; unknown names fall back to the default weight."""
    if name == "oase":
        return composite_weight(points, grid, names, limits, spatial)
    if name == "inverse":
        return points.withColumn("w", inverse_weight(names, limits))
    if name == "pow10":
        return points.withColumn("w", pow10_weight(names))
    return points.withColumn("w", default_weight(names, limits))
