"""Neighbour searches in many dimensions by a metric partition.

A few reference vectors are picked far apart; every row keeps its distances to all of them and belongs to the region of the nearest one. A group's
regions are dealt in order to blocks of about ``BLOCK_ROWS`` rows, those of the searching side to ``LEFT_BLOCKS`` times as many. A search with a radius
visits only the blocks of regions that the triangle inequality leaves: a region's members lie between its least and largest distance, and no nearer
than half the difference of the distances to its reference and to the row's own. The rows of one block that visit another travel together, each vector
once per visited block; their distances come from matrix products, those that may count are then measured component by component. Nearest neighbours
first get a radius from the block that holds the row's region, which bounds the k-th distance from above.
Distances are exact and measured over every column; the partition only leaves out what cannot count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from skytrace.session import attach, row_count, store

REFERENCES = 64  # at most
SAMPLE = 5_000  # rows that references are picked from
BLOCK_ROWS = 16_384  # right rows a task holds at once
LEFT_BLOCKS = 4  # left rows stream past: so many blocks of them share one copy of the right rows
TILE_ROWS = 256  # left rows whose distances to a block are in memory at once
PAIRS = 2**18  # pairs measured and handed on at once
SLACK = 1e-9


def _scaled(df: DataFrame, columns: list[str], bandwidth: list[float]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in columns], *[(F.col(c) / F.lit(float(h))).alias(c) for c, h in zip(columns, bandwidth)])


def references(df: DataFrame, columns: list[str], most: int = REFERENCES) -> np.ndarray:
    """Up to ``most`` rows of a bounded sample, each as far as possible from those before it; more rows need more of them."""
    vector = F.array(*columns)
    rows = np.array([r["v"] for r in df.select(vector.alias("v")).orderBy(F.xxhash64("v")).limit(SAMPLE).collect()], float).reshape(-1, len(columns))
    wanted = max(1, min(most, int(row_count(df) ** 0.5)))
    picked, gap = [], np.full(len(rows), np.inf)
    while len(picked) < wanted and len(rows) and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((rows - rows[picked[-1]]) ** 2).sum(axis=1))
    return rows[picked]


def placed(df: DataFrame, columns: list[str], refs: np.ndarray) -> DataFrame:
    """``df`` with row numbers ``_row``, vectors ``_v``, their distances ``_to`` to the references, the nearest one's number ``_region`` and distance ``_far``.

    Store the result before it is used: row numbers are those of one run.
    """
    def run(vectors: pa.Array) -> pa.Array:
        m = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, refs.shape[1])
        out = np.stack([((m - r) ** 2).sum(axis=1) for r in refs], axis=1) ** 0.5
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, len(refs), dtype=np.int32)), pa.array(out.ravel()))

    out = df.withColumns({"_row": F.monotonically_increasing_id(), "_v": F.array(*columns)}).withColumn("_to", F.arrow_udf(run, "array<double>")("_v"))
    return out.withColumn("_far", F.array_min("_to")).withColumn("_region", (F.array_position("_to", F.col("_far")) - 1).cast("int"))


def regions_of(right: DataFrame, on: list[str]) -> DataFrame:
    """(on, _region, _count, _low, _high): members of every region and their least and largest distance to its reference."""
    return store(right.groupBy(*on, "_region").agg(F.count("*").alias("_count"), F.min("_far").alias("_low"), F.max("_far").alias("_high")))


def _spans(regions: DataFrame, on: list[str]) -> DataFrame:
    """``regions`` with the number of the group's members in the regions before, by which rows are dealt to blocks."""
    before = Window.partitionBy(*on).orderBy("_region").rowsBetween(Window.unboundedPreceding, -1)
    return store(regions.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0))))


def _dealt(rows: DataFrame, spans: DataFrame, on: list[str], row: str, name: str, size: int) -> DataFrame:
    """``rows`` with the number of their block of ``size`` rows in the group: a region's rows are spread evenly over its span."""
    at = F.col("_before") + F.pmod(F.xxhash64(row), F.col("_count"))
    out = attach(rows, spans.select(*on, "_region", "_count", "_before"), [*on, "_region"], row, part_of=spans)
    return out.withColumn(name, F.floor(at / F.lit(size))).drop("_count", "_before")


def _with_regions(left: DataFrame, spans: DataFrame, on: list[str]) -> DataFrame:
    """Left rows with ``_held``: the regions of their group, and the first and last block of each."""
    first, last = F.floor(F.col("_before") / F.lit(BLOCK_ROWS)), F.floor((F.col("_before") + F.col("_count") - 1) / F.lit(BLOCK_ROWS))
    held = spans.groupBy(*on).agg(F.collect_list(F.struct("_region", "_low", "_high", first.alias("_from"), last.alias("_till"))).alias("_held"))
    return attach(left, held, on, "_row", part_of=spans)


def _vectors(part: pa.RecordBatch) -> np.ndarray:
    return part.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _block(parts: list[pa.RecordBatch], names: list[str], k: int | None) -> tuple[np.ndarray, pa.RecordBatch]:
    """Vectors of a block and the columns ``names``, in the order of the keys; of equal vectors only the first ``k`` can be among the nearest."""
    m = np.concatenate([_vectors(p) for p in parts])
    fine = np.isfinite(m).all(axis=1)
    if k is not None:
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(fine):
            v = m[i].tobytes()
            seen[v] = seen.get(v, 0) + 1
            fine[i] = seen[v] <= k
    kept = pa.Table.from_batches(parts).select(names).filter(pa.array(fine)).combine_chunks()
    return np.asfortranarray(m[fine]), pa.RecordBatch.from_arrays([c.combine_chunks() for c in kept.columns], names=names)


def _measured(q: np.ndarray, c: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """Squared distances of pairs, summed in column order."""
    out = np.zeros(len(qi))
    for j in range(q.shape[1]):
        t = q[qi, j] - c[ci, j]
        out += t * t
    return out


def _near(q: np.ndarray, radius: np.ndarray, c: np.ndarray, k: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in q, place in c, squared distance) of pairs within each row's radius; of the nearest ``k`` at most, ties by the place in c."""
    if not len(c):
        return
    lengths = (c * c).sum(axis=1)
    for start in range(0, len(q), TILE_ROWS):
        m, r2 = q[start:start + TILE_ROWS], radius[start:start + TILE_ROWS] ** 2
        own = (m * m).sum(axis=1)
        # no rounded sum of products is off by more
        error = 4 * (m.shape[1] + 8) * np.finfo(float).eps * (own + lengths.max())
        rough = m @ c.T
        rough *= -2
        rough += own[:, None]
        rough += lengths
        limit = r2 + error
        if k is not None and len(c) > k:
            many = np.flatnonzero(np.count_nonzero(rough <= limit[:, None], axis=1) > k)
            limit[many] = np.minimum(limit[many], np.partition(rough[many], k - 1, axis=1)[:, k - 1] + 2 * error[many])
        qi, ci = np.nonzero(rough <= limit[:, None])
        found = []
        for s in range(0, len(qi), PAIRS):
            a, b = qi[s:s + PAIRS], ci[s:s + PAIRS]
            d2 = _measured(m, c, a, b)
            near = d2 <= r2[a]
            found.append((a[near] + start, b[near], d2[near]))
            if k is None:
                yield found.pop()
        if found:
            a, b, d2 = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((b, d2, a))
            a = a[order]
            best = np.arange(len(a)) - np.searchsorted(a, a) < k
            yield a[best], b[order][best], d2[order][best]


def _search(batches: Iterator[pa.RecordBatch], left: list[str], right: list[str], k: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs of each cell; its right rows arrive first, by key, then its left rows."""
    cell, parts, block = None, [], None
    for batch in batches:
        cells, sides = (batch.column(c).to_numpy() for c in ("_cell", "_side"))
        cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            part = batch.slice(a, b - a)
            if a < b and sides[a] == 0:
                if cells[a] != cell:
                    cell, parts = cells[a], []
                parts.append(part)
                block = None
            elif a < b and cells[a] == cell:
                vectors, names = block = block or _block(parts, right, k)
                mine = part.select(left)
                for qi, ci, d2 in _near(_vectors(part), part.column("_radius").to_numpy(), vectors, k):
                    yield pa.RecordBatch.from_arrays([*mine.take(pa.array(qi)).columns, *names.take(pa.array(ci)).columns, pa.array(d2)], names=[*left, *right, "d2"])


def _pairs(left: DataFrame, right: DataFrame, on: list[str], left_key: str, k: int | None) -> DataFrame:
    """Pairs within ``_radius`` of the blocks that left rows visit, with ``d2`` and every column whose name starts with no underscore."""
    cells = store(left.select(*on, "_block", "_visit").distinct().withColumn("_cell", F.monotonically_increasing_id()))
    mine = [*on, "_row", *dict.fromkeys([left_key, *(c for c in left.columns if c not in on and not c.startswith("_"))])]
    theirs = [c for c in right.columns if c not in on and not c.startswith(("_", "n__"))]
    asked = attach(left, cells, [*on, "_block", "_visit"], "_row", part_of=cells).select("_cell", F.lit(1).alias("_side"), "_v", F.col("_radius") * (1 + SLACK) + SLACK, *mine)
    held = attach(right, cells, [*on, "_visit"], "n__row", part_of=cells).select("_cell", F.lit(0).alias("_side"), F.col("n__v").alias("_v"), "n__key", *theirs)
    rows = held.unionByName(asked.toDF("_cell", "_side", "_v", "_radius", *mine), allowMissingColumns=True)
    rows = rows.repartition("_cell").sortWithinPartitions("_cell", "_side", "n__key")
    schema = StructType([*(StructField(c, rows.schema[c].dataType) for c in [*mine, *theirs]), StructField("d2", DoubleType())])
    return rows.mapInArrow(lambda it: _search(it, mine, theirs, k), schema)


def candidates(left: DataFrame, right: DataFrame, regions: DataFrame, on: list[str], left_key: str, k: int | None = None) -> DataFrame:
    """Pairs within the left row's ``_radius``, with ``d2``, or those that may be among its ``k`` nearest; right columns have the prefix n_."""
    radius = F.col("_radius") * (1 + SLACK) + SLACK

    def reached(h: Column) -> Column:
        off = F.get("_to", h["_region"])
        return (off - h["_high"] <= radius) & (h["_low"] - off <= radius) & ((off - F.col("_far")) / 2 <= radius)

    spans = _spans(regions, on)
    asked = _with_regions(_dealt(left, _spans(regions_of(left, on), on), on, "_row", "_block", BLOCK_ROWS * LEFT_BLOCKS), spans, on)
    blocks = F.flatten(F.transform(F.filter("_held", reached), lambda h: F.sequence(h["_from"], h["_till"])))
    asked = asked.withColumn("_visit", F.explode(F.array_distinct(blocks))).drop("_held", "_to")
    return _pairs(asked, _dealt(right, spans, on, "n__row", "_visit", BLOCK_ROWS), on, left_key, k).drop("_row")


def _named(right: DataFrame, on: list[str], right_key: str) -> DataFrame:
    """Right rows under the prefix n_, with what the search needs of them."""
    rest = [c for c in right.columns if c not in (*on, "_region", "_to")]
    return right.select(*on, "_region", *[F.col(c).alias("n_" + c) for c in rest], F.col(right_key).alias("n__key"))


def _both(left: DataFrame, right: DataFrame, columns: list[str], bandwidth: list[float]) -> tuple[DataFrame, DataFrame, np.ndarray]:
    same = left is right
    right = store(_scaled(right, columns, bandwidth))
    refs = references(right, columns)
    if not len(refs):
        refs = np.zeros((1, len(columns)))
    right = store(placed(right, columns, refs).drop(*columns))
    return (right if same else store(placed(_scaled(left, columns, bandwidth), columns, refs).drop(*columns))), right, refs


def within(
    left: DataFrame, right: DataFrame, radius: float, columns: list[str], bandwidth: list[float], left_key: str, right_key: str, on: tuple[str, ...]
) -> DataFrame:
    """Pairs of a group whose distance in bandwidth-scaled space is at most ``radius``, with ``d2``; right columns get the prefix n_.

    The columns of the vectors are left out. No component may be null.
    """
    q, x, _ = _both(left, right, columns, bandwidth)
    pairs = candidates(q.withColumn("_radius", F.lit(float(radius))), _named(x, [*on], right_key), regions_of(x, [*on]), [*on], left_key)
    return pairs.where(F.col("d2") <= float(radius) ** 2)


def first_radius(q: DataFrame, x: DataFrame, regions: DataFrame, k: int, columns: list[str], left_key: str, right_key: str, on: list[str]) -> DataFrame:
    """``q`` without ``columns``, with ``_radius``: the k-th distance in the block that holds the row's region, infinite where the block is smaller."""
    q, spans = q.drop(*columns), _spans(regions, on)
    nearest_first = F.array_sort(F.transform("_held", lambda h: F.struct(F.get("_to", h["_region"]).alias("_off"), h["_from"].alias("_from"))))
    asked = _with_regions(_dealt(q, _spans(regions_of(q, on), on), on, "_row", "_block", BLOCK_ROWS * LEFT_BLOCKS), spans, on)
    asked = asked.select(*on, left_key, "_row", "_v", "_block", F.get(nearest_first, F.lit(0))["_from"].alias("_visit"), F.lit(float("inf")).alias("_radius"))
    held = _named(x.select(*on, "_region", "_row", "_v", right_key), on, right_key)
    found = _pairs(asked, _dealt(held, spans, on, "n__row", "_visit", BLOCK_ROWS), on, left_key, k)
    last = found.groupBy("_row").agg(F.when(F.count("*") == k, F.sqrt(F.max("d2"))).alias("_radius"))
    return q.join(last, "_row", "left").withColumn("_radius", F.coalesce("_radius", F.lit(float("inf"))))


def nearest(
    left: DataFrame, right: DataFrame, k: int, columns: list[str], bandwidth: list[float], left_key: str, right_key: str, on: tuple[str, ...]
) -> DataFrame:
    """Exact k nearest neighbours in bandwidth-scaled space: (on, left_key, rank, n_right_key, distance), ties by the right key."""
    on = [*on]
    q, x, _ = _both(left, right, columns, bandwidth)
    regions = regions_of(x, on)
    asked = store(first_radius(q, x, regions, k, columns, left_key, right_key, on))
    found = candidates(asked, _named(x, on, right_key), regions, on, left_key, k)
    order = Window.partitionBy(*on, left_key).orderBy("d2", "n_" + right_key)
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(*on, left_key, "rank", "n_" + right_key, F.sqrt("d2").alias("distance"))
