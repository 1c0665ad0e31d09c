"""Near copies by five-word shingles in the pipeline's stage, against all pairs."""

import random

import numpy as np
from helpers import documents, simhash as slow_simhash

import corpus_pipeline
from skytrace.llm import alike


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def like(a, b):
    a, b = shingles(a), shingles(b)
    return bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


def heads(texts):
    root, sets, prints = list(range(len(texts))), [shingles(t) for t in texts], [slow_simhash(t) for t in texts]
    for j in range(len(texts)):
        for i in range(j):
            near = sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            if near or (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return sorted({*root})


def edited(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_stage_keeps_one_of_near_copies(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 150, 400]))) for _ in range(30)]
    for t in texts[:20]:
        chain = t
        for _ in range(3):
            chain = edited(rng, chain, max(1, len(t.split()) // rng.choice([25, 45, 80])))
            texts.append(chain)
    texts += ["", "a b", "A  b", "a b c"]
    want = heads(texts)
    lost = sum((slow_simhash(a) ^ slow_simhash(b)).bit_count() > 2 for i, a in enumerate(texts) for b in texts[:i] if like(a, b))
    assert lost > 20 and len(want) < len(texts) - 20
    got = corpus_pipeline.near_dedup_stage(spark, documents(spark, enumerate(texts)), "").collect()
    assert sorted(r["doc_id"] for r in got) == want


def test_edges(spark):
    """Nulls, blanks, repeated rows, ids without a value, clashing columns, an empty table."""
    long = " ".join(f"x{i}" for i in range(300))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (4, long), (None, long + " tail"), (6, "one"), (7, "one"), (8, "b " * 200_000)]
    docs = documents(spark, rows, {"sid": 1, "keys": "k", "gid": 2, "found": 3, "least": 4})
    kept = alike.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 6, 8]
    assert alike.keep_one(docs.limit(0)).count() == 0


def test_a_chain_inside_one_group_is_followed(spark, monkeypatch):
    """Members that the smallest set doesn't reach, but others do, are found when the group is decided whole."""
    monkeypatch.setattr(alike, "band_keys", lambda found: np.arange(alike.BANDS, dtype=np.uint64))
    words = [f"x{i}" for i in range(200)]
    texts = [" ".join(words[s:s + 150]) for s in (0, 10, 20, 30, 40)] + ["other words " + " ".join(f"y{i}" for i in range(100))]
    got = alike.keep_one(documents(spark, enumerate(texts))).collect()
    assert sorted(r["doc_id"] for r in got) == heads(texts) == [0, 5]


def test_spanning_is_all_pairs():
    rng = np.random.default_rng(0)
    base = np.arange(40)
    sets = [np.unique(np.concatenate([rng.permutation(base)[:rng.integers(30, 41)], rng.integers(100, 140, rng.integers(0, 6))])) for _ in range(80)]
    root = list(range(80))
    for j in range(80):
        for i in range(j):
            if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    mine = list(range(80))
    links = alike.spanning(sets)
    for i, j in links:
        a, b = sorted((mine[i], mine[j]))
        assert a != b
        mine = [a if r == b else r for r in mine]
    assert mine == root and len(links) == 80 - len({*root}) > 10
