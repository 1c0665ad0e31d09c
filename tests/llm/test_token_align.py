"""Alignment against a model that compares every pair of tokens, with the tokenizers' own files."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from helpers import documents
from tokenizers import Tokenizer

from skytrace.llm import token_align
from skytrace.llm.common import table, vocabulary


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


def spans(parts):
    out, at = [], 0
    for i, raw in parts:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def tokens(coders, text):
    """[(id, start, end)] of both sides; none if the bytes differ."""
    a, b = coders
    letters = token_align.byte_letters()
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    if not text or b"".join(x for _, x in left) != raw or b"".join(x for _, x in right) != raw:
        return [], []
    return spans(left), spans(right)


def slow(coders, rows):
    each, counts = [], Counter()
    for _, text in rows:
        left, right = tokens(coders, text or "")
        links = [(i, j) for i, s, e in left for j, t, f in right if max(s, t) < min(e, f)]
        counts.update(links)
        ends = sorted({e for _, _, e in left} & {e for _, _, e in right})
        groups, at = [], 0
        for end in ends:
            groups.append(tuple(",".join(str(i) for i, s, e in side if at <= s and e <= end) for side in (left, right)))
            at = end
        shown = ";".join("|".join(g) for g in groups)
        each.append((len(left), len(right), len(ends), links, hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return sorted(((d, a, b, g, len(l), sum(counts[x] == best[x[1]] for x in l), sum(counts[x] for x in l), h) for (d, _), (a, b, g, l, h) in zip(rows, each)), key=str)


ODD = [None, "", " ", "  ", "a", " lead", "trail ", "tab\tx\r\n\n y", "café naïve", "▁mark", "a▁b", "<|endoftext|> <s> </s> <0x0A>", "\u0000\u0001", "\U0001f600\U0001f468‍\U0001f469", "日本語", "é", "﻿x", " ", "a\n \nb \n", "1234567890" * 5, "it's we'll", "a" * 300, "ab " * 200]


def test_against_all_pairs(spark, sf_dir, coders):
    rows = list(enumerate(ODD)) + [(3, "a"), (3, "a"), (None, "a b")]
    rows += [(1000 + r["doc_id"], r["text"][:600]) for r in table(spark, sf_dir, "documents").limit(60).collect()]
    df = documents(spark, rows, {"row": 1, "n_a": 2, "pairs": 3, "pair": 4})
    assert sorted((tuple(r) for r in token_align.align(df).collect()), key=str) == slow(coders, rows)


def test_merged_lookups(spark, coders, monkeypatch):
    monkeypatch.setattr("skytrace.llm.common.LOOKUP_ROWS", 0)
    rows = list(enumerate(ODD))
    assert sorted((tuple(r) for r in token_align.align(documents(spark, rows)).collect()), key=str) == slow(coders, rows)


def test_whole_texts_keep_the_file_s_ids(spark, sf_dir, coders):
    coder = token_align.ByteLevelCoder(vocabulary("byte_bpe_50k.json"))
    texts = [" " + r["text"] for r in table(spark, sf_dir, "documents").collect() if r["text"]] + [t for t in ODD if t]
    texts += [" " * 5000 + "x", "\n" * 100_000, " \n" * 3000 + "b"]
    assert coder.encode(texts) == [e.ids for e in coders[0].encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("step", [1, 2, 3, 7, 1000])
def test_pieces_of_any_size(step):
    rng = random.Random(step)
    for _ in range(30):
        total = rng.randint(1, 60)
        a, b = (np.array(sorted({*rng.sample(range(1, total + 1), rng.randint(1, total)), total})) for _ in "ab")
        at_a, at_b = token_align.merge_cuts(a, b, step)
        assert all(n <= step for n in np.diff(at_a) + np.diff(at_b))
        m = token_align.merged(a, b, step)
        starts = [np.concatenate([[0], e[:-1]]) for e in (a, b)]
        want = {(i, j) for i in range(len(a)) for j in range(len(b)) if max(starts[0][i], starts[1][j]) < min(a[i], b[j])}
        found = list(zip(m.link_a.tolist(), m.link_b.tolist()))
        assert len(found) == len(want) and {*found} == want
        assert (m.last_a == np.isin(a, b)).all() and (m.last_b == np.isin(b, a)).all()


def test_long_text_and_empty_table(spark):
    text = "word" * 100_000 + " " * 50_000 + "\n" * 50_000 + "end. " * 50_000
    row = token_align.align(documents(spark, [(1, text)])).first()
    assert row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"] > 0 and len(row["groups_sha256"]) == 64
    assert token_align.align(documents(spark, [])).count() == 0
