"""Decontamination against a brute-force model."""

import re

from helpers import documents
from hypothesis import given, settings
from hypothesis import strategies as st

from skytrace.llm import decontam


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s:s + n]), set()).add(item)
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s:s + n])]
        out.append((d, len(w), len(hit), len(found - {None}), bool(hit)))
    return sorted(out, key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cd"]), max_size=40), st.integers(3, 12))
def test_shared_runs_keep_a_hash(tokens, n):
    """Winnowing's promise: equal windows keep equal hashes, wherever they stand."""
    texts = [" ".join(tokens), "x y " + " ".join(tokens) + " z"]
    p = decontam.WinnowParams()
    kept = [{(w["words"], w["kept"]) for w in decontam._scan(t.encode(), (10, n) if n < 10 else (10,), p, None)[1]} for t in texts]
    assert kept[0] <= kept[1]


def test_blocks_change_nothing(monkeypatch):
    text = " ".join(f"w{i * i % 31}" for i in range(400)).encode()
    p = decontam.WinnowParams()
    whole = decontam._scan(text, (4, 10), p, None)
    monkeypatch.setattr(decontam, "BLOCK", 60)
    total, found = decontam._scan(text, (4, 10), p, None)
    order = lambda rows: sorted((r["n"], r["start"], r["kept"], r["words"]) for r in rows)
    assert total == whole[0] and order(found) == order(whole[1])


def test_against_brute_force(spark):
    base = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(base[:25])), (2, "Short ITEM, only"), (3, " ".join(base[10:22])), (4, None), (5, "..."), (6, "w3 " * 14), (None, " ".join(base[40:52])), (7, "same w1 w2")]
    docs = [(1, "intro " + " ".join(base[5:16]) + " end"), (2, " ".join(base[5:14])), (3, "a SHORT-item only b"), (4, None), (5, ""), (6, "w3 " * 40),
            (7, " ".join(base[:30]) + " " + " ".join(base[8:25])), (7, "other text of the same id"), (8, " ".join(base[38:55])), (9, "é" * 5), (10, "q " * 40000 + " ".join(base[:10])), (1, "intro " + " ".join(base[5:16]) + " end")]
    d = documents(spark, docs, {"dk": "mine", "n": "mine", "words": "mine"})
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontam.contamination(d, b).collect()), key=str)
    assert got == slow(docs, items)
    kept = decontam.without_leaks(d, b)
    assert kept.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(x[0]) for x in slow(docs, items) if not x[4])
    assert not any(r["contaminated"] for r in decontam.contamination(d, b.limit(0)).collect())
    assert decontam.contamination(d.limit(0), b).count() == 0
