"""Consecutive numbers and exact medians without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytrace.session import attach, keep, row_count

ROWS_PER_PART = 200_000
_LOCAL_BITS = 33  # of monotonically_increasing_id: the row's number inside its partition


def number_rows(df: DataFrame, order: str | list[str | Column], out: str) -> DataFrame:
    """1..N in the given order (unique keys, numbers or text).

    Rows are range-partitioned by the order, in as many parts as their count asks for, sorted inside each and stored; a row's number is its place in its
    part plus the counts of the parts before.
    """
    order = [order] if isinstance(order, str) else order
    parts = max(1, -(-row_count(df) // ROWS_PER_PART))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = keep(ranged.withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_place", _LOCAL_BITS))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per part: N / ROWS_PER_PART rows of two numbers
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.col("_place").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    numbered = placed.join(F.broadcast(offsets), "_part").withColumn(out, (F.col("_before") + local + 1).cast("bigint"))
    return numbered.drop("_part", "_place", "_before")


MEDIAN_BINS = 1024


def group_medians(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Exact medians per group as doubles, NULLs left out (NULL if nothing else is there).

    All columns go through one plan with (group, column) as key: counts of the values are stored, each key is histogrammed, and
    only the bins that hold the middle ranks are sorted, so a hot group is spread.
    """
    if not columns:
        return df.select(group).distinct()
    stacked = F.array(*[F.struct(F.lit(i).alias("_var"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])
    values = df.select(group, F.explode(stacked).alias("_x")).select(group, "_x.*")
    # NULLs are counted too, so that groups without any value are known from the stored table
    counted = keep(values.groupBy(group, "_var", "_v").agg(F.count("*").alias("_n")))
    medians = _binned_medians(counted.where("_v IS NOT NULL"), [group, "_var"])
    wide = medians.groupBy(group).agg(*[F.max(F.when(F.col("_var") == i, F.col("_median"))).alias(c) for i, c in enumerate(columns)])
    return counted.select(group).distinct().join(wide, group, "left")


def _binned_medians(counted: DataFrame, keys: list[str], bins: int = MEDIAN_BINS) -> DataFrame:
    """(*keys, _median) of a stored table of values and their counts (*keys, _v, _n)."""
    # one row per key, a key's rows are spread by the value hash
    span = keep(counted.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_total")))
    position = F.try_divide((F.col("_v") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))
    binned = attach(counted, span, keys, "_v", part_of=span).withColumn(
        "_bin", F.least(F.coalesce(F.floor(position), F.lit(0)), F.lit(bins - 1)).cast("int")
    )
    per_bin = binned.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_bn"), F.first("_total").alias("_total"))
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    middle = keep(
        per_bin.withColumn("_end", F.sum("_bn").over(upto))
        .withColumn("_start", F.col("_end") - F.col("_bn"))
        .withColumn("_r1", F.floor((F.col("_total") + 1) / 2))
        .withColumn("_r2", F.floor(F.col("_total") / 2) + 1)
        .where("(_start < _r1 AND _r1 <= _end) OR (_start < _r2 AND _r2 <= _end)")
        .select(*keys, "_bin", "_start", "_r1", "_r2")
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        attach(binned.select(*keys, "_bin", "_v", "_n"), middle, [*keys, "_bin"], "_v", part_of=middle)
        .withColumn("_to", F.col("_start") + F.sum("_n").over(inside))
        .withColumn("_from", F.col("_to") - F.col("_n"))
    )
    hit = lambda r: F.max(F.when((F.col("_from") < F.col(r)) & (F.col(r) <= F.col("_to")), F.col("_v")))
    return ranked.groupBy(*keys).agg(((hit("_r1") + hit("_r2")) / 2.0).alias("_median"))
