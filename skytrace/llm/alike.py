"""Links between texts whose sets of word 5-grams have a Jaccard similarity of at least 0.8.

Min-hash bands (24 keys of four values each) bring candidates together: a pair at exactly 0.8 shares no key with probability
(1 - 0.8^4)^24, three in a million, a closer pair less. The candidates' whole sets then decide, so no link is a guess. Equal sets are
compared once, and groups with equal members too. A group's smallest set meets the others one by one; only a group that is not connected by then
is looked at whole, where a set is compared only with those that nothing has reached yet. No pairs are returned, only links that span each linked set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.llm.common import bound_batches, components, give_back, lookup, text_or_empty
from skytrace.llm.simhash import SEED, _splitmix, _word_blocks, fingerprint, keep_heads, text_key
from skytrace.session import store

WORDS = 5
LIKE = (4, 5)  # the similarity as a fraction, so that its comparison is exact
BANDS, VALUES = 24, 4
CHUNK = 2048
_FLIPS = _splitmix(np.arange(5000, 5000 + BANDS * VALUES, dtype=np.uint64))[:, None]
_FACTORS = _splitmix(np.arange(9000, 9000 + BANDS * VALUES, dtype=np.uint64))[:, None] | np.uint64(1)
_BAND = np.arange(BANDS, dtype=np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased word 5-grams; a shorter text is one shingle, one without words has none."""
    parts, short = [], []
    for words in _word_blocks(text.lower(), WORDS):
        if len(words) < WORDS:
            short = words
            continue
        each = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
        mixed = np.zeros(len(words) - WORDS + 1, np.uint64)
        for i in range(WORDS):
            mixed = _splitmix(mixed ^ each[i:i + len(mixed)])
        parts.append(np.unique(mixed))
    if parts:
        return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
    return np.array([xxhash.xxh64_intdigest(b" ".join(short), SEED)] if short else [], np.uint64)


def band_keys(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * VALUES, 2**64 - 1, np.uint64)
    for at in range(0, len(found), CHUNK):
        np.minimum(least, ((found[at:at + CHUNK] ^ _FLIPS) * _FACTORS).min(axis=1), out=least)
    keys = _BAND
    for column in least.reshape(BANDS, VALUES).T:
        keys = _splitmix(keys ^ column)
    return keys


def _bytes(texts: pa.Array):
    return (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts.cast(pa.large_binary()))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _named_keys(texts: pa.Array) -> pa.Array:
    """Per text: its fingerprint; where it has words, the hash of its set and the set's keys follow."""
    out = []
    for text in _bytes(texts):
        found = shingles(text)
        name = [xxhash.xxh64_intdigest(found.tobytes(), SEED)] if len(found) else []
        out.append(np.concatenate([np.array([fingerprint(text), *name], np.uint64), band_keys(found) if name else found]))
    named = _lists(out)
    give_back()
    return named


def _sets(texts: pa.Array) -> pa.Array:
    sets = _lists([shingles(t) for t in _bytes(texts)])
    give_back()
    return sets


def spanning(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (i, j) that span the sets connected by pairs of enough similarity, exactly."""
    sizes = np.array([len(s) for s in sets])
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark, left, links = np.zeros(len(words), bool), np.arange(len(sets)), []
    rest, at = flat, starts[:-1]
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, new = [int(left[0])], np.arange(len(left)) == 0
        else:
            i = queue.pop()
            mine = flat[starts[i]:starts[i + 1]]
            mark[mine] = True
            shared = np.add.reduceat(mark[rest], at, dtype=np.int64)
            mark[mine] = False
            new = LIKE[1] * shared >= LIKE[0] * (sizes[i] + sizes[left] - shared)
            links += [(i, int(j)) for j in left[new]]
            queue += [int(j) for j in left[new]]
        if new.any():
            rest = rest[np.repeat(~new, sizes[left])]
            left = left[~new]
            at = np.concatenate([[0], np.cumsum(sizes[left])])[:-1]
    return links


def _links(groups: pa.Array) -> pa.Array:
    out = []
    for group in groups:
        members = group.values
        names, held = members.field("sid").to_pylist(), members.field("found")
        links = spanning([s.values.to_numpy(zero_copy_only=False) for s in held])
        out.append([{"a": names[i], "b": names[j]} for i, j in links])
    return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))


def named_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, fp, sid, keys) of every row: text hash, fingerprint, set hash and band keys (null without words), all in one pass."""
    udf = F.arrow_udf(_named_keys, "array<long>")
    named = bound_batches(docs).select("doc_id", text_key().alias("tk"), udf(text_or_empty()).alias("named"))
    keys = F.when(F.size("named") > 2, F.slice("named", 3, BANDS))
    return named.select("doc_id", "tk", F.get("named", F.lit(0)).alias("fp"), F.get("named", F.lit(1)).alias("sid"), keys.alias("keys"))


def _close(a: Column, b: Column) -> Column:
    """Whether two sets (arrays of distinct values) are similar enough."""
    shared = F.size(F.array_intersect(a, b))
    return LIKE[1] * shared >= LIKE[0] * (F.size(a) + F.size(b) - shared)


def linked_sets(docs: DataFrame, named: DataFrame) -> DataFrame:
    """(a, b): links between the set hashes of ``named``, the stored ``named_sets(docs)``, that connect what similar pairs connect.

    First every group's smallest set is compared with the others of the group, pair by pair; copies share their groups, so
    that these pairs are few and settle nearly all groups. A group whose members are still in several components is then decided as a whole.
    """
    once = named.where("sid IS NOT NULL").groupBy("sid").agg(F.first("keys").alias("keys"), F.min(F.struct("doc_id", "tk")).alias("at"))
    once = store(once.select("sid", "keys", F.col("at.doc_id").alias("at_id"), F.col("at.tk").alias("at_tk")))
    groups = once.select("sid", F.explode("keys").alias("key")).groupBy("key").agg(F.array_sort(F.collect_list("sid")).alias("sids"))
    groups = store(groups.where(F.size("sids") > 1).groupBy(F.xxhash64("sids").alias("gid")).agg(F.first("sids").alias("sids")))
    members = store(groups.select("gid", F.get("sids", F.lit(0)).alias("least"), F.explode("sids").alias("sid")))
    wanted = store(lookup(once, store(members.select("sid").distinct()), "sid", "left_semi").select("sid", "at_id", "at_tk"))
    texts = bound_batches(docs).select("doc_id", text_or_empty().alias("text")).withColumn("tk", F.xxhash64("text"))
    texts = lookup(texts, wanted, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("tk") == F.col("at_tk"))).select("sid", "text")
    sets = F.arrow_udf(_sets, "array<long>")
    found = store(texts.select("sid", sets("text").alias("found")).groupBy("sid").agg(F.first("found").alias("found")))
    pairs = store(members.where("least <> sid").select(F.col("least").alias("a"), F.col("sid").alias("b")).distinct())
    for end in ("b", "a"):
        pairs = pairs.join(found.select(F.col("sid").alias(end), F.col("found").alias("found_" + end)), end)
    first = store(pairs.where(_close(F.col("found_a"), F.col("found_b"))).select("a", "b"))
    placed = lookup(members.select("gid", "sid"), components(first).withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    open_groups = placed.groupBy("gid").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("gid")
    links = F.arrow_udf(_links, "array<struct<a:long,b:long>>")
    rest = lookup(members.select("gid", "sid"), store(open_groups), "gid", "left_semi")
    rest = rest.join(found, "sid").groupBy("gid").agg(F.collect_list(F.struct("sid", "found")).alias("sets"))
    return first.unionByName(rest.select(F.explode(links("sets")).alias("l")).select("l.a", "l.b")).distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each set of near-duplicates: fingerprints within two bits, or texts whose sets are similar enough.

    Which row stays, and what holds for nulls and repeated rows, is told at :func:`simhash.keep_heads`. Texts without words are linked by
    their fingerprint (zero) only.
    """
    named = store(named_sets(docs))
    both = store(named.where("sid IS NOT NULL").select("sid", "fp").distinct())
    least = store(both.groupBy("sid").agg(F.min("fp").alias("least")))
    same = lookup(both, least, "sid").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    links = store(linked_sets(docs, named))
    for end in ("a", "b"):
        links = lookup(links, least.withColumnRenamed("sid", end), end).drop(end).withColumnRenamed("least", end)
    return keep_heads(docs, named, store(links.select("a", "b").unionByName(same).where("a <> b").distinct()))
