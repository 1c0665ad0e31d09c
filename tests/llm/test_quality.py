"""Quality classifier: held-out accuracy, what it may learn from, edge cases, pooling over whole texts."""

import zlib

import numpy as np
import pytest
from helpers import documents

from skytrace.llm import quality
from skytrace.llm.common import table

DATA = "/root/testdata/sf0.01"
SMALL = quality.TrainParams(per_class=40, epochs=3)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    return quality.Model(rng.normal(0, 1, (5, 256, 4)).astype(np.float32), np.zeros(4, np.float32), rng.normal(0, 1, 9))


def slow_chunks(model, text):
    """Window by window."""
    codes = list(text) + [0] * (quality.WIDTH - 1)
    n = max(1, len(text))
    codes = codes if text else [0] * quality.WIDTH
    acts = np.array([sum(model.weights[j][codes[t + j]].astype(float) for j in range(quality.WIDTH)) for t in range(n)])
    starts = range(0, max(1, n - (quality.CHUNK - quality.STEP)), quality.STEP) if n > quality.CHUNK else [0]
    return np.array([np.maximum(acts[s:s + quality.CHUNK].max(axis=0), 0) for s in starts])


@pytest.mark.parametrize("size", [0, 1, 4, 63, 64, 65, 511, 512, 513, 960, 961, 2000, 9000])
def test_chunks_cover_the_text(model, size):
    text = bytes(np.random.default_rng(size).integers(32, 127, size).astype(np.uint8))
    want = slow_chunks(model, text)
    got = quality.chunk_maxima(model, text)
    assert got.max(axis=0) == pytest.approx(want.max(axis=0), abs=1e-4)
    assert got.shape == want.shape and got == pytest.approx(want, abs=1e-4)


def test_a_late_byte_counts(model):
    text = b"a" * 50_000
    assert quality.score_text(model, text) != quality.score_text(model, text + b"!#!#!")


def test_held_out_accuracy(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    rows = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for d, r in rows.items())
    held = [(rows[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert sum(p == y for p, y in held if y == 1) >= 0.97 * sum(y for _, y in held)


def test_held_out_labels_change_nothing(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    some = docs.where("doc_id < 200")
    scores = [sorted(tuple(r) for r in quality.quality_scores(some, x, SMALL).collect()) for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (3, "x" * 100_000), (None, "text"), (4, "same"), (4, "same")]
    d = documents(spark, rows, {"score": "mine", "quality": "mine", "held_out": "mine"})
    none = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality_scores(d, none).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    more = documents(spark, [(i, "###&&& $$$ " * 9 if i % 2 == 0 else "plain words here " * 9) for i in range(60)])
    out = quality.quality_scores(more, labels, SMALL).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in out)
    scores = {}
    for r in quality.quality_scores(d, labels, SMALL).collect():
        scores.setdefault(r["doc_id"], []).append(r["score"])
    assert scores[1] == scores[2] and len(scores[4]) == 2 and len(set(scores[4])) == 1
    assert quality.quality_scores(d.limit(0), labels, SMALL).count() == 0
    assert quality.keep_good(d, none).columns == d.columns
