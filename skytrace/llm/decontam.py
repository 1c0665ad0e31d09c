"""Benchmark decontamination by winnowing.

Texts are lower-cased words. Every k-gram of words has a hash; of the k-grams inside a window of ``span`` words the one with the smallest
hash is kept, so two texts that share ``span`` words in a row keep the same k-gram there. Training windows whose kept hash is
in the benchmark's presence filter (a bit table of fixed size) leave the Python workers; the rest is DataFrame work: join on the kept hash, extend
each hit to the whole window word by word, unite the hit words and list the items. An item shorter than a window is one
window of its own length; its only kept hash is that of the whole item, and documents are checked for all runs of such lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytrace.llm.common import bound_batches, doc_key, give_back, lookup, text_or_empty
from skytrace.session import store

FILTER_BITS = 24
BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCHEMA = "doc_id {id}, dk string, n_words long, cands array<struct<start:long,n:int,kept:long,words:string>>"


@dataclass(frozen=True)
class WinnowParams:
    span: int = 10  # words of a window: every shared run of so many words is found
    gram: int = 5  # words of a k-gram


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class _Hasher:
    """Hashes of word runs from prefix sums over the bytes (a polynomial modulo 2^64, then mixed)."""

    _up, _down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __init__(self, words: list[bytes]):
        flat = np.frombuffer(b" ".join(words), np.uint8)
        if len(flat) + 1 > len(_Hasher._up):
            _Hasher._up, _Hasher._down = _powers(2 * len(flat) + 2)
        self.sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(flat * _Hasher._up[:len(flat)], out=self.sums[1:])
        gaps = np.flatnonzero(flat == 32)
        self.starts, self.ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(flat)]])

    def runs(self, n: int) -> np.ndarray:
        first, last = self.starts[:len(self.starts) - n + 1], self.ends[n - 1:]
        x = (self.sums[last] - self.sums[first]) * _Hasher._down[first] + np.uint64(n)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _windows(words: list[bytes], sizes: tuple[int, ...], p: WinnowParams) -> Iterator[tuple[int, np.ndarray]]:
    """For each window size the kept hash of every window of the words."""
    hasher = _Hasher(words)
    for n in sizes:
        if len(words) >= n:
            grams = hasher.runs(min(p.gram, n) if n == p.span else n)
            width = len(grams) - (len(words) - n)
            kept = grams[:len(words) - n + 1].copy()
            for shift in range(1, width):
                np.minimum(kept, grams[shift:shift + len(kept)], out=kept)
            yield n, kept


def _scan(text: bytes, sizes: tuple[int, ...], p: WinnowParams, table: np.ndarray | None) -> tuple[int, list[dict]]:
    """Word count and the windows whose kept hash is in the presence table (all of them without one)."""
    text, out, total, carry, at = text.translate(_LETTERS), [], 0, [], 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            gap = text.find(b" ", end)
            end = len(text) if gap < 0 else gap
        fresh = text[at:end].split()
        words = carry + fresh
        base = total - len(carry)
        for n, kept in _windows(words, sizes, p) if words else ():
            new = max(0, len(carry) - n + 1)
            hits = np.arange(new, len(kept)) if table is None else np.flatnonzero(
                (table[kept[new:] >> np.uint64(64 - FILTER_BITS + 6)] >> ((kept[new:] >> np.uint64(64 - FILTER_BITS)) & np.uint64(63))) & np.uint64(1)) + new
            for s in hits.tolist():
                out.append({"start": base + s, "n": n, "kept": int(kept[s].astype(np.int64)), "words": b" ".join(words[s:s + n]).decode("utf-8", "replace")})
        total += len(fresh)
        carry, at = words[-(max(sizes) - 1):] if max(sizes) > 1 else [], end
    return total, out


def _item_windows(batches: Iterator[pa.RecordBatch], p: WinnowParams) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = batch.column(0), []
        for i, text in enumerate(batch.column(1).to_pylist()):
            raw = (text or "").encode()
            n = len(raw.translate(_LETTERS).split())
            rows += [{"item": i, **w} for w in (_scan(raw, (min(n, p.span),), p, None)[1] if n else [])]
        taken = ids.take(pa.array([r["item"] for r in rows], pa.int64()))
        yield pa.RecordBatch.from_arrays([
            taken, pa.array([r["n"] for r in rows], pa.int32()), pa.array([r["kept"] for r in rows], pa.int64()),
            pa.array([r["words"] for r in rows], pa.string())], ["item_id", "n", "kept", "words"])


def benchmark_windows(benchmark: DataFrame, p: WinnowParams = WinnowParams()) -> DataFrame:
    """(item_id, n, kept, words): the windows of all items."""
    items = benchmark.select("item_id", text_or_empty().alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    return items.mapInArrow(lambda it: _item_windows(it, p), f"item_id {kind}, n int, kept long, words string")


def presence_table(windows: DataFrame) -> np.ndarray:
    """2^24 bits, set at the kept hashes' leading bits; 2 MB whatever the benchmark's size."""
    top = F.shiftrightunsigned("kept", 64 - FILTER_BITS)
    cells = windows.select(top.alias("at")).distinct().groupBy(F.shiftrightunsigned("at", 6).alias("cell")).agg(
        F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return table


def _document_windows(docs: DataFrame, windows: DataFrame, p: WinnowParams) -> DataFrame:
    sizes = tuple(r[0] for r in windows.select("n").distinct().collect()) or (p.span,)
    shared = docs.sparkSession.sparkContext.broadcast(presence_table(windows))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cands = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int32()), ("kept", pa.int64()), ("words", pa.string())]))
        for batch in batches:
            found = [_scan(t.as_buffer().to_pybytes(), sizes, p, shared.value) for t in batch.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([c for _, c in found], cands)],
                ["doc_id", "dk", "n_words", "cands"])
        give_back()

    keyed = bound_batches(docs).select("doc_id", doc_key().alias("dk"), text_or_empty().alias("text"))
    return keyed.mapInArrow(scan, SCHEMA.format(id=kind))


def contamination(docs: DataFrame, benchmark: DataFrame, p: WinnowParams = WinnowParams()) -> DataFrame:
    """(doc_id, dk, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs(doc_id, text, ...)``.

    Null, empty and wordless texts have no words and are clean; so are all documents if the benchmark has no words. Rows with equal doc_id and
    text are one document and get the same answer once per row. Items with a null id mark words, but are not listed.
    Other columns of either table are not read.
    """
    windows = store(benchmark_windows(benchmark, p))
    read = store(_document_windows(docs, windows, p))
    cands = read.where(F.size("cands") > 0).select("dk", F.explode("cands").alias("c")).select("dk", "c.*").distinct()
    hits = store(lookup(cands, windows.select("kept", "words").distinct(), ["kept", "words"], "left_semi"))
    before = F.max(F.col("start") + F.col("n")).over(Window.partitionBy("dk").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("start") + F.col("n") - F.greatest("start", F.coalesce(before, F.lit(0)))
    marked = hits.select("dk", F.greatest(fresh, F.lit(0)).alias("fresh")).groupBy("dk").agg(F.sum("fresh").alias("n_hit"))
    listed = lookup(hits.select("dk", "words").distinct(), windows.select("words", F.col("item_id").cast("string").alias("item")).distinct(), "words")
    items = listed.groupBy("dk").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = store(marked.join(items, "dk", "left"))
    out = lookup(read.select("doc_id", "dk", "n_words"), found, "dk", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "dk", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, p: WinnowParams = WinnowParams()) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, columns as they are."""
    leaks = contamination(docs, benchmark, p).where("contaminated").select("dk").distinct()
    return lookup(docs.withColumn("_dk", doc_key()), store(leaks.withColumnRenamed("dk", "_dk")), "_dk", "left_anti").drop("_dk")
