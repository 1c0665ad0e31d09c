"""SimHash near-duplicates through pivot distance tables.

A fingerprint is cut into eight bands of eight bits. Each band has its own reference patterns, and the Hamming distances to
them are tabulated once for all 256 band contents (the pivot table). Two fingerprints that differ in at most two bits agree in at least six
bands, so their pivot distances there are equal: one key per choice of six bands, made of those bands' distance vectors, brings
them together. In such a group at most the 16 bits of two bands vary, so a group has at most 65,536 distinct
fingerprints whatever the data. Inside it, distances to 64-bit references discard pairs whose largest coordinate difference
exceeds the limit (triangle inequality), and the survivors are verified bit by bit. A group returns a spanning star per linked
set, never its pairs.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.llm.common import bound_batches, components, lookup, text_or_empty
from skytrace.session import store

SEED = 42
WORDS = 3
MAX_BITS = 2
BANDS = 8
BLOCK = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_blocks(text: bytes, size: int = WORDS):
    """Words of a text in lists of bounded size; a list starts with the last ``size`` - 1 words of the one before."""
    start, tail = 0, []
    while start < len(text):
        end = start + BLOCK
        if end < len(text):
            gap = _SPACE.search(text, end)
            end = gap.start() if gap else len(text)
        words = tail + text[start:end].split()
        yield words
        tail, start = words[-(size - 1):], end


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of lower-cased word 3-grams (XXH64, seed 42); zero if there is no word."""
    ones, total, short = np.zeros(64, np.int64), 0, []
    for words in _word_blocks(text.lower()):
        if len(words) < WORDS:
            short = words
            continue
        joined = map(b" ".join, zip(words, words[1:], words[2:]))
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), np.uint64, len(words) - WORDS + 1)
        total += len(hashes)
        for at in range(0, len(hashes), 1 << 14):
            bits = np.unpackbits(hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
    if not total:
        if not short:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(short), SEED)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    whole = np.fromiter((fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in texts.cast(pa.large_binary())), np.uint64, len(texts))
    return pa.array(whole.view(np.int64))


def _splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def band_pivots(count: int = 16) -> np.ndarray:
    """Reference patterns of a band: zero, the eight single bits, then a fixed pseudo-random sequence."""
    rest = _splitmix(np.arange(count, dtype=np.uint64)).astype(np.uint8)
    return np.concatenate([[0], 1 << np.arange(8), rest])[:count].astype(np.uint8)


def whole_pivots(count: int = 32) -> np.ndarray:
    """64-bit references for the maximum-coordinate test."""
    return _splitmix(np.arange(1000, 1000 + count, dtype=np.uint64))


def band_tables(pivots: np.ndarray) -> np.ndarray:
    """[band, content] -> 64-bit digest of the content's distance vector to the band's pivots."""
    distances = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ pivots[None, :]).astype(np.uint64)
    digest = np.zeros(256, np.uint64)
    for column in distances.T:
        digest = _splitmix(digest ^ column)
    return np.stack([_splitmix(digest ^ np.uint64(band << 56)) for band in range(BANDS)])


_TABLES = band_tables(band_pivots())
_LEFT_OUT = list(combinations(range(BANDS), MAX_BITS))


def _band_keys(prints: pa.Array) -> pa.Array:
    fps = prints.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, BANDS)
    with np.errstate(over="ignore"):
        parts = np.stack([_TABLES[b][fps[:, b]] for b in range(BANDS)], axis=1)
        whole = parts.sum(axis=1, dtype=np.uint64)
        keys = np.stack([_splitmix(whole - parts[:, a] - parts[:, b] ^ np.uint64(i)) for i, (a, b) in enumerate(_LEFT_OUT)], axis=1)
    offsets = np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32) if len(fps) else np.zeros(1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel()))


def _stars(fps: np.ndarray, pivots: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Spanning links of the sets of fingerprints within ``limit`` bits, each to its set's smallest member."""
    fps = np.unique(fps)
    table = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps) - 1):
        near = np.flatnonzero(np.abs(table[i + 1:, 0] - table[i, 0]) <= limit) + i + 1
        near = near[(np.abs(table[near] - table[i]) <= limit).all(axis=1)]
        for j in near[np.bitwise_count(fps[near] ^ fps[i]) <= limit]:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [(int(fps[i].astype(np.int64)), int(fps[r].astype(np.int64))) for i in range(len(fps)) if (r := find(i)) != i]


def _links(groups: pa.Array) -> pa.Array:
    pivots = whole_pivots()
    values, offsets = groups.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(groups.value_lengths().to_numpy())])
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(groups))]
    sizes = np.diff(offsets)
    two = np.flatnonzero(sizes == 2)
    a, b = values[offsets[two]], values[offsets[two] + 1]
    spread = np.abs(np.bitwise_count(a[:, None] ^ pivots).astype(np.int8) - np.bitwise_count(b[:, None] ^ pivots).astype(np.int8))
    for k in np.flatnonzero((spread <= MAX_BITS).all(axis=1)):
        if a[k] != b[k] and np.bitwise_count(a[k] ^ b[k]) <= MAX_BITS:
            out[two[k]] = [(int(a[k].astype(np.int64)), int(b[k].astype(np.int64)))]
    for k in np.flatnonzero(sizes > 2):
        out[k] = _stars(values[offsets[k]:offsets[k + 1]], pivots, MAX_BITS)
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    return pa.array([[{"a": x, "b": y} for x, y in pairs] for pairs in out], kind)


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row's whole text as a signed long; ``more`` columns follow."""
    udf = F.arrow_udf(_fingerprints, "long")
    return bound_batches(docs).select("doc_id", udf(F.col("text").cast("string")).alias("fp"), *more)


def linked_prints(prints: DataFrame) -> DataFrame:
    """(a, b): spanning links between the distinct fingerprints ``prints(fp)`` within two bits."""
    keys = F.arrow_udf(_band_keys, "array<long>")
    found = F.arrow_udf(_links, "array<struct<a:long,b:long>>")
    groups = prints.select("fp", F.explode(keys("fp")).alias("key")).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    return groups.where(F.size("fps") > 1).select(F.explode(found("fps")).alias("l")).select("l.a", "l.b").distinct()


def rooted_prints(prints: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(fp, first, root): the component of every fingerprint of the stored ``prints(doc_id, fp, ...)`` under the two-bit rule and ``links(a, b)``."""
    first = store(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = linked_prints(first.select("fp"))
    root = components(linked.unionByName(links) if links is not None else linked).withColumnRenamed("node", "fp")
    return store(lookup(first, root, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs(doc_id, text, ...)``.

    Rows with equal fingerprints, or fingerprints at most two bits apart, are linked; component_id is the smallest doc_id
    reachable. Null, empty and blank texts have fingerprint zero and are linked like any other. Repeated rows give repeated rows. A null
    doc_id takes part, but never is a component's id unless all its members are null. Other columns are not read.
    """
    found = store(fingerprints(docs))
    rooted = rooted_prints(found)
    smallest = store(rooted.where("root <> fp").select("root").distinct())
    shared = lookup(rooted, smallest, "root", "left_semi")
    of = store(shared.groupBy("root").agg(F.min("first").alias("component_id")))
    named = store(lookup(rooted, of, "root", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))
    return lookup(found, named, "fp").select("doc_id", "fp", "component_id")


def text_key() -> Column:
    """Hash of a document's text; a null text counts as an empty one."""
    return F.xxhash64(text_or_empty())


def keep_heads(docs: DataFrame, prints: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row of each component of the stored ``prints(doc_id, tk, fp)``: that of the smallest doc_id (null last),
    then text hash; of rows equal in both, one. A doc_id that is repeated with other texts stays with each of them that leads a component.

    Texts move only where ids are too many to broadcast; repeated rows, if there are any, are settled apart from the others.
    Columns of ``docs`` called _tk, _head or _head_tk are left out.
    """
    named = lookup(prints.select("doc_id", "tk", "fp"), rooted_prints(prints, links).select("fp", "root"), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tk"))
    heads = store(named.groupBy("root").agg(first.alias("h")).select(F.col("h.doc_id").alias("_head"), F.col("h.tk").alias("_head_tk")))
    repeated = store(prints.groupBy("doc_id", "tk").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_head"), F.col("tk").alias("_head_tk")))
    keyed = docs.drop("_head", "_head_tk").withColumn("_tk", text_key())

    def only(some: DataFrame) -> DataFrame:
        return lookup(keyed, some, F.col("doc_id").eqNullSafe(F.col("_head")) & (F.col("_tk") == F.col("_head_tk")), "left_semi")

    if repeated.isEmpty():
        return only(heads).drop("_tk")
    same = F.col("a._head").eqNullSafe(F.col("b._head")) & (F.col("a._head_tk") == F.col("b._head_tk"))
    single, several = (store(heads.alias("a").join(repeated.alias("b"), same, how)) for how in ("left_anti", "left_semi"))
    return only(single).unionByName(only(several).dropDuplicates(["doc_id", "_tk"])).drop("_tk")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each set of near-duplicates; see :func:`keep_heads`."""
    return keep_heads(docs, store(fingerprints(docs, text_key().alias("tk"))))
