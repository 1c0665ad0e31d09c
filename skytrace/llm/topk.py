"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are ordered by length and dealt into buckets of bounded size; a bucket keeps its longest vector's length, its members by falling
length, and each coordinate of the unit vectors in order. Queries travel in blocks. A query's threshold is its k-th best score in the bucket of
the longest vectors, which every query visits, with the id of that k-th: an equal score counts only with a smaller id. Divided by the query's
and the bucket's length it is a local cosine threshold. Above one, the bucket can't hold a better vector. Otherwise the query chooses,
per bucket, between the members long enough (length pruning) and those whose coordinate at the query's largest one lies in the range that such a
cosine needs (coordinate pruning), whichever leaves fewer; their products are then computed exactly in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytrace.llm.common import bound_batches
from skytrace.session import store

SLACK = 1e-9  # relative slack of the real-valued bounds; products are exact


@dataclass(frozen=True)
class RetrievalParams:
    k: int = 20
    scale: int = 64
    bucket_rows: int = 4096
    query_rows: int = 512


def quantised(vectors: DataFrame, p: RetrievalParams) -> DataFrame:
    """(vec_id, v, norm): floor(scale * x) per component; rows null or with null or non-finite components left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select("vec_id", x.alias("x")).where(F.col("x").isNotNull() & fine & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", F.transform("x", lambda c: F.floor(c * p.scale)).alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))


def _matrix(rows: list[list[int]]) -> np.ndarray:
    """Integer matrix; shorter vectors are filled with zeros."""
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Packs rows (vec_id, v, norm), which arrive by falling norm, into blocks; components in the narrowest integer type."""
    schema = pa.schema([("top", pa.float64()), ("n", pa.int64()), ("bits", pa.int64()), ("ids", pa.list_(pa.int64())), ("norms", pa.list_(pa.float64())), ("vectors", pa.binary())])
    ids: list[int] = []
    rows: list[list[int]] = []
    norms: list[float] = []

    def block() -> pa.RecordBatch:
        m = _matrix(rows)
        bits = next(b for b in (16, 32, 64) if b == 64 or (m.max(initial=0) < 2 ** (b - 1) and m.min(initial=0) >= -(2 ** (b - 1))))
        out = {"top": max(norms), "n": len(ids), "bits": bits, "ids": list(ids), "norms": list(norms), "vectors": m.astype(f"<i{bits // 8}").tobytes()}
        ids.clear(), rows.clear(), norms.clear()
        return pa.RecordBatch.from_pylist([out], schema)

    for batch in batches:
        for vec, v, norm in zip(*(batch.column(i).to_pylist() for i in range(3))):
            ids.append(vec)
            rows.append(v)
            norms.append(norm)
            if len(ids) == size:
                yield block()
    if ids:
        yield block()


BLOCK = "top double, n long, bits long, ids array<long>, norms array<double>, vectors binary"


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors with near norms; equal norms are spread by a hash of the id."""
    count = rows.count()
    order = [F.desc("norm"), F.xxhash64("vec_id")]
    dealt = rows.repartitionByRange(max(1, -(-count // (8 * size))), *order).sortWithinPartitions(*order)
    packed = dealt.mapInArrow(lambda it: _blocks(it, size), BLOCK)
    return store(packed.withColumn("block", F.monotonically_increasing_id()))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: floating point where every sum is below 2^53, 64-bit or Python integers beyond."""
    width = min(q.shape[1], c.shape[1])
    q, c = q[:, :width], c[:, :width]
    bound = float(np.abs(q).astype(float).max(initial=0)) * float(np.abs(c).astype(float).max(initial=0)) * max(width, 1)
    if bound < 2**53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    if bound < 2**62:
        return q @ c.T
    whole = q.astype(object) @ c.T.astype(object)
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _bucket(qids: np.ndarray, q: np.ndarray, floors: np.ndarray, kths: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's best in this bucket, of those that beat the query's floor, at an equal score with an id up to the k-th's."""
    qn, cn = np.sqrt((q.astype(float) ** 2).sum(1)), np.sqrt((c.astype(float) ** 2).sum(1))
    order = np.argsort(-cn, kind="stable")
    ids, c, cn = ids[order], c[order], cn[order]
    width = min(q.shape[1], c.shape[1])
    unit = c[:, :width] / np.maximum(cn, 1e-300)[:, None]
    sorted_at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(floors == -np.inf, -np.inf, floors / np.maximum(qn * cn.max(initial=0), 1e-300))
    whole, chosen = [], {}
    for i in np.flatnonzero(cosine <= 1 + SLACK):
        theta = cosine[i] - SLACK
        long_enough = len(cn)
        if floors[i] > 0:
            long_enough = int(np.searchsorted(-cn, -(floors[i] / qn[i]) * (1 - SLACK), side="right"))
        pick: np.ndarray | None = None
        if theta > 0 and width:
            at = int(np.argmax(np.abs(q[i, :width])))
            x = q[i, at] / qn[i]
            reach = np.sqrt(max(0.0, 1 - theta * theta)) * np.sqrt(max(0.0, 1 - x * x))
            # cosines above theta are allowed as well, so the range ends at the pole when x itself is beyond theta
            low = -1.0 if -x >= theta else x * theta - reach
            high = 1.0 if x >= theta else x * theta + reach
            if at not in sorted_at:
                by = np.argsort(unit[:, at], kind="stable")
                sorted_at[at] = by, unit[by, at]
            by, values = sorted_at[at]
            a, b = np.searchsorted(values, low - SLACK), np.searchsorted(values, high + SLACK, side="right")
            if b - a < long_enough:
                pick = by[a:b]
        if pick is None and long_enough < len(cn) // 2:
            pick = np.arange(long_enough)
        if pick is None or len(pick) > len(cn) // 4:
            whole.append(i)  # little is pruned: one product for all such queries
        elif len(pick):
            chosen[i] = pick
    out: list[tuple[int, int, int]] = []

    def add(i: int, scores: np.ndarray, names: np.ndarray) -> None:
        fine = ((scores > floors[i]) | ((scores == floors[i]) & (names <= kths[i]))) & (names != qids[i])
        scores, names = scores[fine], names[fine]
        out.extend((int(qids[i]), int(names[j]), int(scores[j])) for j in _best(scores, names, k))

    if whole:
        for i, scores in zip(whole, products(q[whole], c)):
            add(i, scores, ids)
    for i, pick in chosen.items():
        add(i, products(q[i:i + 1], c[pick])[0], ids[pick])
    return out


def _read(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(row[f"{prefix}_vectors"], f"<i{row[f'{prefix}_bits'] // 8}").astype(np.int64)
    return np.array(row[f"{prefix}_ids"], np.int64), flat.reshape(row[f"{prefix}_n"], -1)


FOUND = "query_id long, vec_id long, score long"


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            qids, q = _read(row, "q")
            ids, c = _read(row, "c")
            floors = np.array(row["q_floors"], float) if "q_floors" in row else np.full(len(qids), -np.inf)
            kths = np.array(row["q_kths"], np.int64) if "q_kths" in row else np.full(len(qids), 2**63 - 1)
            got = _bucket(qids, q, floors, kths, ids, c, k)
            columns = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=kind)


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}_{c}") for c in df.columns))


def top_k(vectors: DataFrame, is_query: str, p: RetrievalParams = RetrievalParams()) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of ``vectors(vec_id, embedding, ...)``, itself left out.

    Ties go to the smaller vec_id; a query with fewer than k others gets them all. Rows with a null id, a null vector or a null or non-finite component
    take no part. A vector shorter than another counts as filled with zeros; an empty one scores zero. Rows that repeat a vec_id are candidates
    of their own, but one query; a query leaves out all rows of its id. Scores beyond 64 bits are clipped.
    Work: every block of queries meets every bucket that its thresholds don't rule out, as an exact search over all rows must.
    """
    rows = store(quantised(bound_batches(vectors), p))
    buckets = blocks(rows, p.bucket_rows)
    queries = blocks(rows.where(is_query).dropDuplicates(["vec_id"]), p.query_rows)
    c = _named(buckets, "c")
    # 1. the bucket of the longest vectors (one row of bounded size) gives each query its first threshold
    first = buckets.select("block", "top").orderBy(F.desc("top"), "block").limit(1).select(F.col("block").alias("c_block"), F.lit(0).alias("g"))
    tallest = F.broadcast(c.join(F.broadcast(first), "c_block"))
    seen = store(_named(queries, "q").withColumn("g", F.lit(0)).join(tallest, "g").mapInArrow(lambda it: _search(it, p.k), FOUND))
    full = F.count("*") >= p.k
    floor = _top(seen, p.k).groupBy("query_id").agg(
        F.when(full, F.min("score").cast("double")).alias("floor"), F.when(full & (F.abs(F.min("score")) < 2**53), F.max_by("vec_id", "rank")).alias("kth"))
    # 2. thresholds go back to their blocks, in the order of the ids; need: the length below which a bucket can't help any query of the block
    listed = queries.select("block", F.posexplode(F.arrays_zip("ids", "norms")).alias("place", "x")).select("block", "place", F.col("x.ids").alias("query_id"), F.col("x.norms").alias("norm"))
    listed = listed.join(floor, "query_id", "left").withColumns({"floor": F.coalesce("floor", F.lit(float("-inf"))), "kth": F.coalesce("kth", F.lit(2**63 - 1))})
    need = F.when((F.col("floor") > 0) & (F.col("norm") > 0), F.col("floor") / F.col("norm")).when(F.col("floor") > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    floors = listed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "floor", "kth"))).alias("f"), F.min(need).alias("need"))
    held = store(_named(queries.join(floors, "block").withColumns({"floors": F.col("f.floor"), "kths": F.col("f.kth")}).drop("f"), "q"))
    # 3. pairs of blocks by id, groups of buckets spread over tasks, pruned by length before any vector moves
    groups = max(1, min(1024, buckets.count()))
    left = held.select("q_block", "q_need", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    right = c.join(F.broadcast(first.drop("g")), "c_block", "left_anti").select("c_block", "c_top", F.pmod(F.xxhash64("c_block"), F.lit(groups)).cast("int").alias("g"))
    pairs = left.join(right, "g").where(F.col("c_top") * (1 + SLACK) >= F.col("q_need")).select("q_block", "c_block")
    matched = store(pairs).repartition("q_block", "c_block").join(held.drop("q_need", "q_norms"), "q_block").join(c.drop("c_norms"), "c_block")
    rest = matched.mapInArrow(lambda it: _search(it, p.k), FOUND)
    return _top(seen.unionByName(rest), p.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
