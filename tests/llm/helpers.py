"""Small fixtures and brute-force models for the training-data operators."""

from __future__ import annotations

import re
from itertools import combinations

import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra: dict[str, str] | None = None):
    """A documents table from (doc_id, text) pairs, with columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    for name, value in (extra or {}).items():
        df = df.withColumn(name, F.lit(value))
    return df


def simhash(text: str | None) -> int:
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict[int, int], limit: int = 2) -> dict[int, int]:
    """doc_id -> smallest doc_id reachable, over all pairs."""
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= limit:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in prints}
