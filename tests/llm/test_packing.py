"""Packing: the tokenizer's ids, gapless sequences, every id once, little padding."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skytrace.llm import common, packing
from skytrace.llm.common import table
from skytrace.llm.queries import QUERIES

ODD = ["", "<|endoftext|> A<|EndOfText|>b", "ΑΣ ΟΣ σ", "a\x1cb\xa0c d\u0085e", "İstanbul ß ǅ", "é é ẞ", "it's THE I'M don't", " \n\t x\ty", "\U0001f600a"]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(packing.default_vocabulary())


@pytest.fixture(scope="module")
def coder():
    return packing.WordTokenizer(packing.default_vocabulary())


def test_ids_are_the_tokenizers(whole, coder, spark, sf_dir, monkeypatch):
    texts = ODD + [r["text"] or "" for r in table(spark, sf_dir, "documents").limit(60).collect()]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(coder.ids(t), "<u4").tolist() for t in texts] == want
    monkeypatch.setattr(packing, "BLOCK", 40)
    monkeypatch.setattr(packing, "CACHED_WORDS", 100)
    assert [np.frombuffer(coder.ids(t), "<u4").tolist() for t in texts] == want


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=40))
def test_ids_of_any_text(text):
    coder = packing._LOADED.setdefault("test", packing.WordTokenizer(packing.default_vocabulary()))
    assert np.frombuffer(coder.ids(text), "<u4").tolist() == coder.whole.encode(text, add_special_tokens=False).ids


def one_by_one(lengths, capacity):
    """Shortest pack first, piece by piece."""
    packs = []
    for n in sorted(lengths, reverse=True):
        fits = [p for p in packs if sum(p) + n <= capacity]
        if fits:
            min(fits, key=sum).append(n)
        else:
            packs.append([n])
    return Counter(sum(p) for p in packs)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_histogram_packs_like_pieces(lengths):
    got = packing.patterns(dict(Counter(lengths)), 32)
    fill = Counter()
    for packs, parts in got:
        fill[sum(n * k for n, k in parts)] += packs
    assert fill == one_by_one(lengths, 32)


@pytest.mark.parametrize("limit", [0, 300_000])
def test_whole_table(spark, sf_dir, coder, monkeypatch, limit):
    monkeypatch.setattr(common, "LOOKUP_ROWS", limit)
    rows = QUERIES["op6_packing"](spark, sf_dir).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    assert set(pieces) == set(docs)
    for d, mine in pieces.items():
        ids = np.frombuffer(coder.ids(docs[d] or "") + (1).to_bytes(4, "little"), "<u4")
        at = 0
        for r in sorted(mine, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and 0 < r["length"] <= 2048
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padded = 0
    for mine in sequences.values():
        at = 0
        for r in sorted(mine, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padded += (0 if at & (at - 1) == 0 else 2048 - at)
    assert padded < 0.05 * sum(r["length"] for r in rows) + 2048


def test_packing_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "word " * 5000)]
    out = packing.pack(documents(spark, rows, {"length": "mine", "row": "mine", "ids": "mine"})).collect()
    assert Counter(r["doc_id"] for r in out) == {1: 1, 2: 1, 3: 2, None: 1, 4: 3}
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)
    assert all(len(r["ids"]) == 4 * r["length"] for r in out)
    assert packing.pack(documents(spark, rows).limit(0)).count() == 0
