"""Quality classifier: a byte-level convolutional network in numpy.

A filter sees five bytes; its response is a sum of learned weights, one per place and byte value, so a layer is five table lookups. Responses
are max-pooled inside overlapping chunks (512 bytes every 448) that cover the whole document. The largest and the mean chunk response
of each filter go into one logistic output. Training runs on the driver over a bounded sample of labelled documents, of which each
sends at most ``train_chunks`` chunks (spread over the whole text); scoring always reads every byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.llm.common import bound_batches, give_back

WIDTH = 5
SEGMENT = 64
CHUNK_SEGMENTS, STEP_SEGMENTS = 8, 7
CHUNK, STEP = SEGMENT * CHUNK_SEGMENTS, SEGMENT * STEP_SEGMENTS
BLOCK = SEGMENT * 128


@dataclass(frozen=True)
class TrainParams:
    per_class: int = 600  # labelled documents of each class that are used at most
    train_chunks: int = 16  # chunks of a document used at most
    filters: int = 16
    epochs: int = 10
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 7


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # [place, byte, filter]
    bias: np.ndarray  # [filter]
    out: np.ndarray  # [2 x filter + 1]: largest responses, mean responses, constant


def _responses(model: Model, codes: np.ndarray) -> np.ndarray:
    """[window, filter] for windows that start at each byte but the last WIDTH - 1."""
    n = len(codes) - WIDTH + 1
    acts = np.take(model.weights[0], codes[:n], axis=0)
    for j in range(1, WIDTH):
        acts += np.take(model.weights[j], codes[j:j + n], axis=0)
    return acts


def chunk_maxima(model: Model, text: bytes) -> np.ndarray:
    """[chunk, filter]: pooled responses; the text is followed by zero bytes up to a whole window."""
    codes = np.frombuffer(text + bytes(WIDTH - 1), np.uint8)
    n = max(1, len(text))
    codes = codes if len(text) else np.zeros(WIDTH, np.uint8)
    segments = []
    for at in range(0, n, BLOCK):
        acts = _responses(model, codes[at:min(at + BLOCK, n) + WIDTH - 1])
        segments.append(np.maximum.reduceat(acts, np.arange(0, len(acts), SEGMENT), axis=0))
    pooled = np.concatenate(segments) if len(segments) > 1 else segments[0]
    if len(pooled) > CHUNK_SEGMENTS:
        starts = np.arange(0, len(pooled) - CHUNK_SEGMENTS + STEP_SEGMENTS, STEP_SEGMENTS)
        wide = np.concatenate([pooled, np.full((CHUNK_SEGMENTS, pooled.shape[1]), -np.inf, pooled.dtype)])
        best = wide[starts]
        for i in range(1, CHUNK_SEGMENTS):
            best = np.maximum(best, wide[starts + i])
    else:
        best = pooled.max(axis=0, keepdims=True)
    return np.maximum(best + model.bias, 0)


def probability(model: Model, chunks: np.ndarray) -> float:
    f = np.concatenate([chunks.max(axis=0), chunks.mean(axis=0, dtype=np.float64), [1.0]])
    return float(1 / (1 + np.exp(-np.clip(f @ model.out, -40, 40))))


def score_text(model: Model, text: bytes) -> float:
    return probability(model, chunk_maxima(model, text))


def sample_chunks(text: bytes, most: int) -> list[bytes]:
    """Up to ``most`` chunks, evenly spread over the text."""
    count = max(1, -(-max(0, len(text) - (CHUNK - STEP)) // STEP))
    picks = np.unique(np.linspace(0, count - 1, min(count, most)).astype(int))
    return [text[i * STEP:i * STEP + CHUNK + WIDTH - 1] for i in picks]


def _short_slices(samples: list[tuple[list[bytes], int]], rng: np.random.Generator) -> list[tuple[list[bytes], int]]:
    """A slice of 5 to 160 bytes of each good sample: little text is no sign of bad text (a slice of a bad one may be fine, so none of those)."""
    out = []
    for chunks, y in samples:
        whole = chunks[int(rng.integers(len(chunks)))]
        if y == 1 and whole:
            size = int(rng.integers(5, 160))
            start = int(rng.integers(max(1, len(whole) - size)))
            out.append(([whole[start:start + size]], y))
    return out


def train(samples: list[tuple[list[bytes], int]], p: TrainParams = TrainParams()) -> Model:
    """Adam on the class-balanced logistic loss. With fewer than two classes the model answers 0.5 throughout."""
    rng = np.random.default_rng(p.seed)
    weights = rng.normal(0, 0.1, (WIDTH, 256, p.filters)).astype(np.float32)
    model = Model(weights, np.zeros(p.filters, np.float32), np.zeros(2 * p.filters + 1))
    share = np.bincount([y for _, y in samples], minlength=2) / max(1, len(samples))
    share = share * [1, 2]  # the short slices
    if not share.all():
        return Model(np.zeros_like(weights), model.bias, model.out)
    model = Model(weights, model.bias, np.concatenate([rng.normal(0, 0.3, 2 * p.filters), [0.0]]))
    params = [model.weights, model.bias, model.out]
    moments = [(np.zeros(x.shape), np.zeros(x.shape)) for x in params]
    step, batch = 0, 16
    packed = []
    for chunks, y in samples + _short_slices(samples, rng):
        rows = [np.frombuffer(c + bytes(max(0, WIDTH - len(c))), np.uint8) for c in chunks]
        sizes = np.array([len(r) - WIDTH + 1 for r in rows])
        places = [np.concatenate([r[j:j + s] for r, s in zip(rows, sizes)]) for j in range(WIDTH)]
        packed.append((places, np.concatenate([[0], np.cumsum(sizes)[:-1]]), y))
    for _ in range(p.epochs):
        for group in np.array_split(rng.permutation(len(packed)), max(1, len(packed) // batch)):
            grads = [np.zeros(x.shape) for x in params]
            for i in group:
                codes, starts, y = packed[i]
                acts = model.weights[0][codes[0]]
                for j in range(1, WIDTH):
                    acts += model.weights[j][codes[j]]
                tops = np.maximum.reduceat(acts, starts, axis=0)
                chunk_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(acts))))
                hit = acts == tops[chunk_of]
                raw = tops + model.bias
                chunks = np.maximum(raw, 0)
                f = np.concatenate([chunks.max(axis=0), chunks.mean(axis=0), [1.0]])
                error = (1 / (1 + np.exp(-np.clip(f @ model.out, -40, 40))) - y) / (2 * share[y]) / len(group)
                grads[2] += error * f
                g = np.repeat(error * model.out[p.filters:-1][None, :] / len(starts), len(starts), axis=0)
                g[chunks.argmax(axis=0), np.arange(p.filters)] += error * model.out[:p.filters]
                g *= raw > 0
                grads[1] += g.sum(axis=0)
                windows, filters = np.nonzero(hit)
                # a response that occurs several times in a chunk passes its gradient on once
                _, once = np.unique(chunk_of[windows] * p.filters + filters, return_index=True)
                windows, filters = windows[once], filters[once]
                for j in range(WIDTH):
                    np.add.at(grads[0][j], (codes[j][windows], filters), g[chunk_of[windows], filters])
            step += 1
            for x, grad, (m, v) in zip(params, grads, moments):
                grad += p.decay * x
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                x -= (p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(x.dtype)
    return model


def _remainder() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))


def usable_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the labels that may be learnt from."""
    fine = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (_remainder() != 1))
    return fine.groupBy("doc_id").agg(F.min("quality").alias("quality"))


def labelled_sample(docs: DataFrame, labels: DataFrame, p: TrainParams) -> list[tuple[list[bytes], int]]:
    """Chunks and label of at most ``per_class`` documents of each class, chosen by a hash of the id; held-out ids never take part."""
    fine = usable_labels(labels)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = fine.where("quality = 0").orderBy(*order).limit(p.per_class).union(fine.where("quality = 1").orderBy(*order).limit(p.per_class))
    texts = bound_batches(docs).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunks = pa.array([sample_chunks(t.as_py(), p.train_chunks) for t in b.column(1)], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), chunks], ["doc_id", "quality", "chunks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(cut, f"doc_id {kind}, quality int, chunks array<binary>").collect()
    return [([bytes(c) for c in r["chunks"]], r["quality"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def fit(docs: DataFrame, labels: DataFrame, p: TrainParams = TrainParams()) -> Model:
    """Network trained on the balanced sample; its constant then moves to the class shares of all labels that may be learnt from."""
    model = train(labelled_sample(docs, labels, p), p)
    held = {r["quality"]: r["n"] for r in usable_labels(labels).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if model.out.any():
        model.out[-1] += np.log(held[1] / held[0])
    return model


def score_column(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Score of every whole text (null: as an empty one)."""
    shared = bound_batches(docs).sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([score_text(shared.value, t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts.cast(pa.large_binary())], pa.float64())

    return F.arrow_udf(run, "double")(F.col(text).cast("string"))


def quality_scores(docs: DataFrame, labels: DataFrame, p: TrainParams = TrainParams()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text, ...)``.

    Only the text enters a score. Null and empty texts get the score of an empty text. Labels other than 0 and 1 and of a null id are ignored; of several labels of a document the
    smallest counts. Without labels of both classes every score is 0.5. Repeated rows give repeated rows. Other columns are not read.
    """
    model = fit(docs, labels, p)
    rows = docs.select("doc_id", F.coalesce(_remainder() == 1, F.lit(False)).alias("held_out"), score_column(docs, model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, p: TrainParams = TrainParams()) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts to be good, columns as they are; a batch of rows is held at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, p))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary())
            yield batch.filter(pa.array([score_text(shared.value, t.as_buffer().to_pybytes() if t.is_valid else b"") >= 0.5 for t in texts], pa.bool_()))
        give_back()

    return bound_batches(docs).mapInArrow(run, docs.schema)
