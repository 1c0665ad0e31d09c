"""Hard negatives through an inverted multi-index.

Vectors are cut into two halves, each with a codebook of its own; a pair of codewords is a cell, and a cell's radii bound its members'
distance from the codewords. Rows lie in order of their cells, packed into blocks. An anchor's score with any member of a cell is at most the sum of two half bounds, each half
score plus length times radius. A multi-sequence heap walks the cells of a block by falling sum. What is searched for is a set of windows per
anchor: the first k rows of its own (or another) label with a score between two limits. A window is certified as soon as it is full of scores that the next
sum can't reach, or the next sum falls below its lower limit; the walk stops when all windows are. Full windows become floors for the other
blocks, of which only those that a window still needs are searched. Positives are one such window, the negatives one window per positive.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytrace.llm.common import bound_batches
from skytrace.llm.topk import RetrievalParams, products, quantised
from skytrace.session import store

SLACK = 1e-9  # relative slack of the real-valued bounds; scores are exact
LEAST, MOST = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class MiningParams:
    positives: int = 5
    negatives: int = 3
    low: int = 50  # a negative's score is at least so many hundredths of the positive's
    high: int = 95  # and at most so many
    scale: int = 256
    codewords: int = 16  # of each half
    sample: int = 20_000  # rows that the codebooks are fitted on; all rows are indexed
    rounds: int = 8  # of fitting
    block_rows: int = 8192
    anchor_rows: int = 256
    listed: int = 64  # block summaries that meet an anchor block at a time


def fit_codebook(rows: np.ndarray, size: int, rounds: int) -> np.ndarray:
    """k-means from evenly spaced rows; an empty class keeps its codeword."""
    rows = np.unique(rows, axis=0)
    words = rows[np.unique(np.linspace(0, len(rows) - 1, min(size, len(rows))).astype(int))]
    for _ in range(rounds):
        nearest = nearest_word(rows, words)
        for k in range(len(words)):
            if (nearest == k).any():
                words[k] = rows[nearest == k].mean(axis=0)
    return words


def nearest_word(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), 4096):
        some = rows[at:at + 4096]
        out[at:at + 4096] = ((words**2).sum(axis=1) - 2 * some @ words.T).argmin(axis=1)
    return out


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Integer matrix; shorter vectors are filled with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _halves(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return m[:, :m.shape[1] // 2], m[:, m.shape[1] // 2:]


def _celled(batches: Iterator[pa.RecordBatch], books: tuple[np.ndarray, np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, v) with their cell."""
    for batch in batches:
        m = _matrix(batch.column(2).to_pylist(), width).astype(float)
        first, second = (nearest_word(half, book) for half, book in zip(_halves(m), books))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first * len(books[1]) + second)], ["vec_id", "label", "v", "cell"])


BLOCK = "ids array<long>, labels array<long>, cells array<int>, bits int, vectors binary, held array<int>, radii array<double>"


def _packed(batches: Iterator[pa.RecordBatch], books: tuple[np.ndarray, np.ndarray], width: int, size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that arrive by cell; ``held`` lists a block's cells, ``radii`` two numbers for each."""
    names = ["ids", "labels", "cells", "bits", "vectors", "held", "radii"]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.float64())]
    rows: list[tuple] = []

    def block() -> pa.RecordBatch:
        ids, labels, vectors, cells = zip(*rows)
        rows.clear()
        m, cells = _matrix(vectors, width), np.array(cells)
        far = [((half - book[code]) ** 2).sum(axis=1) ** 0.5 for half, book, code in zip(_halves(m.astype(float)), books, divmod(cells, len(books[1])))]
        held, starts = np.unique(cells, return_index=True)
        radii = np.stack([np.maximum.reduceat(f, starts) for f in far], axis=1)
        bits = next(b for b in (16, 32, 64) if b == 64 or (m.max(initial=0) < 2 ** (b - 1) and m.min(initial=0) >= -(2 ** (b - 1))))
        out = [ids, labels, cells.tolist(), bits, m.astype(f"<i{bits // 8}").tobytes(), held.tolist(), radii.ravel().tolist()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, kinds)], names)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append(row)
            if len(rows) == size:
                yield block()
    if rows:
        yield block()


@dataclass(frozen=True)
class Index:
    books: tuple[np.ndarray, np.ndarray]
    width: int
    blocks: DataFrame
    count: int
    params: MiningParams


def build(rows: DataFrame, p: MiningParams) -> tuple[Index, DataFrame] | None:
    """The index over ``rows(vec_id, label, v)`` and the rows with their cells; None without rows."""
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return None
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(p.sample).select("v").collect()
    halves = _halves(_matrix([r["v"] for r in sample], width).astype(float))
    books = tuple(fit_codebook(half, p.codewords, p.rounds) for half in halves)
    shared = rows.sparkSession.sparkContext.broadcast(books)
    celled = store(rows.select("vec_id", "label", "v").mapInArrow(lambda it: _celled(it, shared.value, width), "vec_id long, label long, v array<long>, cell long"))
    order = ["cell", F.xxhash64("vec_id", "v")]
    dealt = celled.repartitionByRange(max(1, -(-celled.count() // (4 * p.block_rows))), *order).sortWithinPartitions(*order)
    packed = dealt.mapInArrow(lambda it: _packed(it, shared.value, width, p.block_rows), BLOCK)
    blocks = store(packed.withColumn("block", F.monotonically_increasing_id()))
    return Index(books, width, blocks, blocks.count(), p), celled


def bounds(q: np.ndarray, books: tuple[np.ndarray, np.ndarray], codes: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """[anchor, code] for one half after the other: half score plus length times radius, with slack."""
    out = []
    for half, book, code, radius in zip(_halves(q), books, codes, radii):
        length = (half**2).sum(axis=1) ** 0.5
        reach = np.outer(length, radius)
        scores = half @ book[code].T
        out.append(scores + reach + SLACK * (np.abs(scores) + reach + 1))
    return out


WINDOWS = "array<struct<w:int,same:boolean,k:int,low:long,high:long,floor:long,floor_id:long>>"
_ANCHOR = f"struct<place:long,id:long,label:long,v:array<long>,windows:{WINDOWS}>"


def _need(windows: list[dict]) -> float:
    """The least score that some window still takes."""
    return min((max(w["low"], w["floor"]) for w in windows), default=float("inf"))


def _wanted(batches: Iterator[pa.RecordBatch], books, width: int) -> Iterator[pa.RecordBatch]:
    """(a_block, d_block, bound) of the blocks that some anchor of a block may still need."""
    kind = pa.schema([("a_block", pa.int64()), ("d_block", pa.int64()), ("bound", pa.float64())])
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            q = _matrix([a["v"] for a in row["anchors"]], width).astype(float)
            needs = np.array([_need(a["windows"]) for a in row["anchors"]], float)
            found = []
            for s in row["summaries"]:
                codes, radii = np.divmod(np.array(s["held"]), len(books[1])), np.array(s["radii"]).reshape(-1, 2).T
                best = sum(bounds(q, books, codes, radii)).max(axis=1)
                if (best >= needs).any():
                    found.append((row["a_block"], s["block"], float(best.max())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kind.types)], schema=kind) if found else pa.RecordBatch.from_pylist([], kind)


class _Window:
    """The first k rows of a window so far, among rows that reach its floor."""

    def __init__(self, w: dict):
        self.w, self.same, self.k, self.low, self.high, self.floor, self.floor_id = (w[x] for x in ("w", "same", "k", "low", "high", "floor", "floor_id"))
        self.low = max(self.low, self.floor)
        self.held: list[tuple[int, int]] = []  # (-score, id), in order

    def add(self, scores: np.ndarray, ids: np.ndarray, same: np.ndarray) -> None:
        fine = (scores >= self.low) & (scores <= self.high) & (same if self.same else ~same)
        if len(self.held) == self.k:
            fine &= scores >= -self.held[-1][0]
        if fine.any():
            scores, ids = scores[fine], ids[fine]
            order = np.lexsort((ids, -scores))[:self.k]
            fresh = [(-int(s), int(i)) for s, i in zip(scores[order], ids[order]) if s > self.floor or i <= self.floor_id]
            self.held = sorted(self.held + fresh)[:self.k]

    def open(self, bound: float) -> bool:
        """Whether rows with scores up to ``bound`` may still matter."""
        return bound >= self.low and (len(self.held) < self.k or bound >= -self.held[-1][0])


def walk(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, place in first, place in second) of all pairs by falling sum."""
    by_first, by_second = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap, seen = [(-(first[by_first[0]] + second[by_second[0]]), 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        yield -total, int(by_first[i]), int(by_second[j])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(first) and b < len(second) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (-(first[by_first[a]] + second[by_second[b]]), a, b))


def search_block(anchors: list[dict], block: dict, books, width: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """[(anchor_id, w, vec_id, score)] of every window's best rows in a block, and how many rows were scored."""
    ids, labels = np.array(block["ids"], np.int64), np.array(block["labels"], np.int64)
    v = np.frombuffer(block["vectors"], f"<i{block['bits'] // 8}").astype(np.int64).reshape(len(ids), width)
    cells, held = np.array(block["cells"]), np.array(block["held"])
    starts = np.append(np.searchsorted(cells, held), len(cells))
    place = {int(c): k for k, c in enumerate(held)}
    radii = np.array(block["radii"]).reshape(-1, 2)
    codes = np.divmod(held, len(books[1]))
    words = [np.unique(c) for c in codes]
    # a codeword's radius is the largest of its cells here
    reach = [np.array([radii[codes[h] == word, h].max() for word in words[h]]) for h in (0, 1)]
    q = _matrix([a["v"] for a in anchors], width)
    first, second = bounds(q.astype(float), books, words, reach)
    exact = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(width, 1) < 2**53
    real, asked = v.astype(float), q.astype(float)
    out, scored = [], 0
    for n, a in enumerate(anchors):
        windows = [_Window(w) for w in a["windows"]]
        for bound, i, j in walk(first[n], second[n]):
            if not any(w.open(bound) for w in windows):
                break
            at = place.get(int(words[0][i] * len(books[1]) + words[1][j]))
            if at is None:
                continue
            rows = slice(starts[at], starts[at + 1])
            scores = (real[rows] @ asked[n]).astype(np.int64) if exact else products(q[n:n + 1], v[rows])[0]
            scored += len(scores)
            other = ids[rows] != a["id"]
            same = labels[rows] == a["label"]
            for w in windows:
                w.add(scores[other], ids[rows][other], same[other])
        out += [(a["id"], w.w, i, -s) for w in windows for s, i in w.held]
    return out, scored


FOUND = "anchor_id long, w int, vec_id long, score long"


def _searched(batches: Iterator[pa.RecordBatch], books, width: int) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("anchor_id", pa.int64()), ("w", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            found, _ = search_block(row["anchors"], row, books, width)
            columns = zip(*found) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind.types)], schema=kind)


def _ranked(found: DataFrame) -> DataFrame:
    return found.withColumn("n", F.row_number().over(Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id")))


def windowed(index: Index, anchors: DataFrame) -> DataFrame:
    """(anchor_id, w, n, vec_id, score): the first k rows of every window; ``anchors(a_block, place, id, label, v, windows)``."""
    p, width = index.params, index.width
    shared = anchors.sparkSession.sparkContext.broadcast(index.books)

    def grouped(df: DataFrame) -> DataFrame:
        one = F.struct("place", "id", "label", "v", "windows").cast(_ANCHOR)
        return store(df.groupBy("a_block").agg(F.collect_list(one).alias("anchors")))

    def wanted(blocks: DataFrame) -> DataFrame:
        parts = max(1, -(-index.count // p.listed))
        summaries = index.blocks.select(F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), F.struct("block", "held", "radii").alias("s"))
        summaries = summaries.groupBy("part").agg(F.collect_list("s").alias("summaries"))
        each = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(summaries, "part")
        return store(each.select("a_block", "anchors", "summaries").mapInArrow(lambda it: _wanted(it, shared.value, width), "a_block long, d_block long, bound double"))

    def searched(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
        dealt = pairs.select("a_block", "d_block").repartition("a_block", "d_block").join(blocks, "a_block")
        dealt = dealt.join(index.blocks.withColumnRenamed("block", "d_block"), "d_block").drop("a_block", "d_block")
        return store(dealt.mapInArrow(lambda it: _searched(it, shared.value, width), FOUND))

    # 1. each block of anchors searches the block with the highest sum; full windows become floors
    once = grouped(anchors)
    best = store(wanted(once).groupBy("a_block").agg(F.max_by("d_block", F.struct("bound", "d_block")).alias("d_block")))
    seen = searched(best, once)
    k = F.explode("windows").alias("x")
    sizes = anchors.select(F.col("id").alias("anchor_id"), k).select("anchor_id", F.col("x.w").alias("w"), F.col("x.k").alias("k"))
    full = _ranked(seen).join(sizes, ["anchor_id", "w"]).where("n = k").select("anchor_id", F.struct("w", "score", "vec_id").alias("f"))
    floors = full.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list("f").alias("floors"))

    def raised(x):
        mine = F.get(F.filter("floors", lambda f: f["w"] == x["w"]), F.lit(0))
        return F.struct(x["w"], x["same"], x["k"], x["low"], x["high"], F.coalesce(mine["score"], x["floor"]).alias("floor"), F.coalesce(mine["vec_id"], x["floor_id"]).alias("floor_id"))

    # 2. the other blocks that a window still needs
    again = grouped(anchors.join(floors, "id", "left").withColumn("windows", F.transform("windows", raised)))
    rest = searched(wanted(again).join(best, ["a_block", "d_block"], "left_anti"), again)
    return _ranked(seen.unionByName(rest)).join(sizes, ["anchor_id", "w"]).where("n <= k").drop("k")


def _windows(w, same: bool, k: int, low, high):
    parts = [w.cast("int").alias("w"), F.lit(same).alias("same"), F.lit(k).alias("k"), low.cast("long").alias("low"), high.cast("long").alias("high"), F.lit(LEAST).alias("floor"), F.lit(MOST).alias("floor_id")]
    return F.struct(*parts)


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(vectors: DataFrame, is_anchor: str, p: MiningParams = MiningParams()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``vectors(vec_id, embedding, label, ...)``.

    A score is the integer inner product of scaled, floored components; higher ones come first, ties by smaller vec_id. An anchor's positives
    are its first rows of the same label, their negatives the first rows of other labels with ``low`` % to ``high`` % of the positive's score (none for a
    negative positive score). Rows with a null id, label or vector, or a null or non-finite component, take no part. A shorter
    vector counts as filled with zeros. Rows that repeat a vec_id are candidates of their own but one anchor (that of the smallest vector, then label), which leaves out
    all rows of its id. Scores beyond 64 bits are clipped. Fewer rows than asked for give what there is; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    named = bound_batches(vectors).where("label IS NOT NULL").select("vec_id", F.struct("embedding", F.col("label").cast("long").alias("label")).alias("e"))
    rows = quantised(named.select(F.struct("vec_id", "e.label").alias("vec_id"), F.col("e.embedding").alias("embedding")), RetrievalParams(scale=p.scale))
    rows = store(rows.select(F.col("vec_id.vec_id").cast("long").alias("vec_id"), F.col("vec_id.label").alias("label"), F.transform("v", lambda x: x.cast("long")).alias("v")).where("vec_id IS NOT NULL"))
    built = build(rows, p)
    if built is None:
        return spark.createDataFrame([], MINED)
    index, celled = built
    ones = celled.where(is_anchor).groupBy(F.col("vec_id").alias("id")).agg(F.min(F.struct("v", "label", "cell")).alias("r")).select("id", "r.v", "r.label", "r.cell")
    order = ["cell", "id"]
    dealt = ones.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()).drop("cell")
    anchors = store(dealt.withColumn("a_block", F.floor(F.col("place") / p.anchor_rows)))
    one = _windows(F.lit(0), True, p.positives, F.lit(LEAST), F.lit(MOST))
    positives = store(windowed(index, anchors.withColumn("windows", F.array(one))).select("anchor_id", F.col("n").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    wide = F.col("positive_score").cast("decimal(25,0)")
    low, high = F.ceil(wide * p.low / 100), F.floor(wide * p.high / 100)
    limits = positives.withColumns({"low": low, "high": high}).where("low <= high")
    windows = limits.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(_windows(F.col("w"), False, p.negatives, F.col("low"), F.col("high"))).alias("windows"))
    negatives = windowed(index, store(anchors.join(windows, "id")))
    return negatives.join(positives, ["anchor_id", "w"]).select(
        "anchor_id", "positive_id", F.col("n").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
